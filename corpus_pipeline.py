"""The corpus pipeline; see ``affinis.llm.pipeline``."""

from affinis.llm.pipeline import ORACLE_SQL as ORACLE_SQL
from affinis.llm.pipeline import STAGES as STAGES
from affinis.llm.pipeline import run as run
