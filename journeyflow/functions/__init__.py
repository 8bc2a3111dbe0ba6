"""Column-level helpers: scalar (I*) and array (J*) functions. All are built-in Spark expressions."""

from journeyflow.functions.scalar import *  # noqa: F401,F403
from journeyflow.functions.arrays import *  # noqa: F401,F403
