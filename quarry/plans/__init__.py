"""Named queries over the test tables, each with the SQL it must equal."""

from .registry import ORACLE, QUERIES  # noqa: F401  isort: skip
from . import answers, entities, evidence, graphs, intervals, logs, records, relational, rules, search, stores, streams, texts, timetables  # noqa: F401
