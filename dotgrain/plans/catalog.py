"""All registered queries of the screening engine, and their SQL."""

from . import advanced, basic

QUERIES = {**basic.QUERIES, **advanced.QUERIES}
ORACLE = {**basic.ORACLE, **advanced.ORACLE}
