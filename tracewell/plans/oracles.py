"""All SQL twins of the catalogue."""

from tracewell.plans.checks_sql import CHECK_ORACLES
from tracewell.plans.oracle_sql import ORACLES as CORE
from tracewell.plans.stored_sql import STORED_ORACLES

ORACLES = CORE | CHECK_ORACLES | STORED_ORACLES
