from procmon.catalog import quality  # noqa: F401
from procmon.catalog import timegrid  # noqa: F401
from procmon.catalog import models  # noqa: F401
from procmon.catalog import periods  # noqa: F401
from procmon.catalog import states  # noqa: F401
