import sys; sys.path.insert(0, __file__.rsplit("/", 2)[0])
