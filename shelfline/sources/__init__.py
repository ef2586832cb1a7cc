from .roles import Roles
from .testdata import load_roles

__all__ = ["Roles", "load_roles"]
