from .registry import ALL, FEATURES, VARIANTS, features, register

__all__ = ["ALL", "FEATURES", "VARIANTS", "features", "register"]
