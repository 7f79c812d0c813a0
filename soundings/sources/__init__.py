from soundings.sources.scan import *  # noqa: F401,F403
from soundings.sources.sink import *  # noqa: F401,F403
