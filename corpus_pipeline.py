"""The corpus pipeline, which is part of gristmill.llm."""

from gristmill.llm.pipeline import ORACLE_SQL as ORACLE_SQL
from gristmill.llm.pipeline import STAGES as STAGES
from gristmill.llm.pipeline import run as run
