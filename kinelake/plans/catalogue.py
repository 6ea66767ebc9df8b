"""All registered queries of the engine itself, each with its SQL where SQL can express it."""

from kinelake.plans import admission, analysis, exports, identity, motion, retrieval, timelines  # noqa: F401  (they register their queries)
from kinelake.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
