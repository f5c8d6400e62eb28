from emberlattice.functions.bands import *  # noqa: F401,F403
from emberlattice.functions.columns import *  # noqa: F401,F403
