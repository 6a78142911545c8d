"""The corpus pipeline of four stages; counted as part of the subpackage llm, where the stages are."""

from kelpline.llm.pipeline import ORACLE_SQL as ORACLE_SQL
from kelpline.llm.pipeline import STAGES as STAGES
from kelpline.llm.pipeline import run as run
