"""Every operator as a query over the driver's tables, with the SQL it is checked against."""

from canopyframe.queries import fits, graph, histories, models, preparation, statistics  # noqa: F401
from canopyframe.queries.registry import QUERIES  # noqa: F401
