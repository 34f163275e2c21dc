"""All registered queries."""

from profilar.plans import models, preparation, relations  # noqa: F401
from profilar.plans.registry import COVERS, QUERIES, SQL  # noqa: F401
