"""Command-output and symbol queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from trailmark.operators import commands, shrink, symbols
from trailmark.plans.text import logs, searches
from trailmark.sources.adapters import table


def outputs(spark, sf_dir):
    a = logs(spark, sf_dir).select(F.lit("tail app.log").alias("command"), F.col("text").alias("output"))
    b = searches(spark, sf_dir).select(F.lit("grep -rn x src").alias("command"), F.col("text").alias("output"))
    c = table(spark, sf_dir, "pages").select(F.concat(F.lit("curl "), "url").alias("command"), F.col("html").alias("output"))
    return a.unionByName(b).unionByName(c)


def sketches(spark, sf_dir):
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield texts.map(shrink.schema, na_action="ignore")

    sketch = F.pandas_udf(run, "string")
    return table(spark, sf_dir, "events").select("event_id", sketch("props").alias("sketch"))


def sources(spark, sf_dir):
    k = F.col("p_partkey")
    content = F.concat(F.lit("import os\nfrom ..lib import f"), (k % 5).cast("string"), F.lit("\n\nclass C"), k.cast("string"), F.lit(":\n    def run(self):\n        pass\n"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/k"), k.cast("string"), F.when(k % 10 == 0, ".txt").otherwise(".py")).alias("path"), content.alias("content"))


_PART = "SELECT 'src/k' || p_partkey || '.py' AS path, p_partkey AS k FROM part WHERE p_partkey % 10 <> 0"

PLANS = {
    "cmp1_18_19_compressed_outputs": (lambda s, d: commands.compressed(outputs(s, d)).select("command", "result.*"), None),
    "cmp8_json_sketches": (
        sketches,
        "SELECT event_id, 'JSON (' || length(trim(props)) || ' bytes):' || chr(10) || '{' || chr(10) || '  k: number' || chr(10) || '}' AS sketch FROM events",
    ),
    "sym1_symbols": (
        lambda s, d: symbols.symbols(sources(s, d)),
        f"""WITH p AS ({_PART}) SELECT path, 'import' AS kind, 'os' AS name, 'os' AS source, 1 AS line FROM p UNION ALL SELECT path, 'import', 'f' || (k % 5), '..lib', 2 FROM p
        UNION ALL SELECT path, 'class', 'C' || k, '', 4 FROM p UNION ALL SELECT path, 'method', 'run', '', 5 FROM p""",
    ),
}
