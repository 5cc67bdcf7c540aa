"""Option strings such as "-i bicgstab -p ilut -tol 1e-10" for the solvers and eigensolvers."""

from __future__ import annotations

import shlex

from krylith.plans import solvers

#: Names by number (fixed values of the option interface).
SOLVERS = ("", "cg", "bicg", "cgs", "bicgstab", "bicgstabl", "gpbicg", "tfqmr", "orthomin", "gmres", "jacobi", "gs", "sor", "bicgsafe", "cr", "bicr", "crs", "bicrstab", "gpbicr", "bicrsafe", "fgmres", "idrs", "idr1", "minres", "cocg", "cocr")
PRECONDITIONERS = ("none", "jacobi", "iluk", "ssor", "hybrid", "is", "sainv", "saamg", "iluc", "ilut", "bjacobi")
EIGENSOLVERS = ("", "pi", "ii", "rqi", "cg", "cr", "si", "li", "ai", "gpi", "gii", "grqi", "gcg", "gcr", "gsi", "gli", "gai")
RULES = ("nrm2_r", "nrm2_b", "nrm1_b")
SCALINGS = ("none", "jacobi", "symm_diag")
STATUS = {solvers.SUCCESS: "normal end", solvers.BREAKDOWN: "breakdown", solvers.MAXITER: "too many iterations"}
#: Options of the preconditioners: option, preconditioner, parameter.
DETAILS = {"ilu_fill": ("iluk", "fill", int), "ssor_omega": ("ssor", "omega", float), "is_alpha": ("is", "alpha", float), "is_m": ("is", "m", int), "sainv_drop": ("sainv", "drop", float), "iluc_drop": ("iluc", "drop", float), "ilut_drop": ("ilut", "drop", float), "ilut_rate": ("ilut", "rate", float), "saamg_theta": ("saamg", "theta", float), "hybrid_i": ("hybrid", "method", str), "hybrid_tol": ("hybrid", "tol", float), "hybrid_maxiter": ("hybrid", "maxiter", int), "adds_iter": ("adds", "iterations", int)}


def words(text: str | list[str]) -> list[tuple[str, str]]:
    """Pairs (option without dash, value) of a string or an argument list."""
    parts = shlex.split(text) if isinstance(text, str) else list(text)
    if len(parts) % 2 or any(not p.startswith("-") for p in parts[::2]):
        raise ValueError(f"options come as -name value: {parts}")
    return [(k.lstrip("-"), v) for k, v in zip(parts[::2], parts[1::2])]


def named(value: str, names: tuple[str, ...]) -> str:
    """A name, or the name of a number."""
    found = names[int(value)] if value.isdigit() and int(value) < len(names) else value
    if found not in names or not found:
        raise ValueError(f"unknown name {value}")
    return found


def flag(value: str) -> bool:
    if value not in ("true", "false", "1", "0"):
        raise ValueError(f"not true or false: {value}")
    return value in ("true", "1")


def solver_options(text: str | list[str]) -> dict:
    """The arguments of solvers.solve, with initx_zeros, scale and precision beside them."""
    out: dict = {"method": "bicg", "precon": "none", "tol": 1e-12, "maxiter": 1000, "rule": "nrm2_r", "tol_w": 1.0, "initx_zeros": True, "scale": "none", "precision": "double"}
    details: dict = {}
    inner: dict = {}
    schwarz = False
    for name, value in words(text):
        if name == "i":
            out["method"] = named(value, SOLVERS)
        elif name == "p":
            out["precon"] = named(value, (*PRECONDITIONERS, "adds"))
        elif name == "conv_cond":
            out["rule"] = named(value, RULES)
        elif name == "scale":
            out["scale"] = named(value, SCALINGS)
        elif name == "f":
            out["precision"] = named(value, ("double", "quad"))
        elif name in ("tol", "tol_w"):
            out[name] = float(value)
        elif name == "maxiter":
            out[name] = int(value)
        elif name == "initx_zeros":
            out[name] = flag(value)
        elif name == "adds":
            schwarz = flag(value)
        elif name in ("restart", "ell", "irestart", "omega"):
            inner[name] = float(value) if name == "omega" else int(value)
        elif name in DETAILS:
            details[name] = value
        elif name != "print":
            raise ValueError(f"unknown option -{name}")
    if out["tol"] < 0 or out["maxiter"] < 0:
        raise ValueError("tol and maxiter can't be negative")
    arguments = {"gmres": {"restart": "restart"}, "fgmres": {"restart": "restart"}, "orthomin": {"restart": "restart"}, "bicgstabl": {"ell": "degree"}, "idrs": {"irestart": "s"}, "sor": {"omega": "omega"}}.get(out["method"], {})
    out |= {arguments[k]: v for k, v in inner.items() if k in arguments}
    given = {"inner": out["precon"]} if schwarz else {}
    out["precon_options"] = given | {DETAILS[k][1]: DETAILS[k][2](v) for k, v in details.items() if DETAILS[k][0] in (out["precon"], "adds" if schwarz else "")}
    if schwarz:
        out["precon"] = "adds"
    return out


def eigen_options(text: str | list[str]) -> dict:
    """The arguments of solvers.eigen."""
    out: dict = {"method": "cr", "tol": 1e-12, "maxiter": 1000, "count": 1, "shift": 0.0}
    for name, value in words(text):
        if name == "e":
            out["method"] = named(value, EIGENSOLVERS)
        elif name == "etol":
            out["tol"] = float(value)
        elif name == "emaxiter":
            out["maxiter"] = int(value)
        elif name == "ss":
            out["count"] = int(value)
        elif name == "shift":
            out["shift"] = float(value)
        elif name == "i":
            out["inner"] = named(value, SOLVERS)
        elif name not in ("eprint", "initx_ones", "ie", "ige", "p"):
            raise ValueError(f"unknown option -{name}")
    if out["count"] < 1:
        raise ValueError("ss must be at least 1")
    return out


def run(a, b, text: str | list[str] = "") -> solvers.Result:
    """Solves as the options say; scale applies to the system beforehand, quad uses double-double BiCG."""
    import numpy as np

    from krylith.functions import double_double
    from krylith.plans.runtime import LocalOperator

    given = solver_options(text)
    scale, precision = given.pop("scale"), given.pop("precision")
    given.pop("initx_zeros")
    if precision == "quad":
        if given["method"] != "bicg" or given["precon"] != "none":
            raise ValueError("quad is there for bicg without a preconditioner")
        x, k, size = double_double.bicg(double_double.QuadOperator(*a.entries(), a.n), double_double.Quad(b), given["tol"], given["maxiter"])
        return solvers.Result(x.hi + x.lo, k, size, solvers.SUCCESS if size <= given["tol"] else solvers.MAXITER, [], 0.0, "bicg", "none")
    if scale == "none":
        return solvers.solve(a, b, **given)
    i, j, v = a.entries()
    d = a.diagonal()
    d = np.where(d == 0, 1.0, d)
    if scale == "jacobi":
        return solvers.solve(LocalOperator(i, j, v / d[i], a.n), b / d, **given)
    root = 1 / np.sqrt(np.abs(d))
    found = solvers.solve(LocalOperator(i, j, v * root[i] * root[j], a.n), b * root, **given)
    found.x = found.x * root
    return found
