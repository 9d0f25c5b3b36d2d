"""Dependency queries: commands built from events, and tables of vulnerabilities and versions built from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import deps
from trailmark.sources.adapters import table


def commands(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    s = lambda c: c.cast("string")
    text = F.when(F.col("k") % 3 == 0, F.concat(F.lit('cd x && pip install -q "Pkg'), s(F.col("k") % 9), F.lit("[extra]==1."), s(F.col("k") % 5), F.lit('.0" -r req.txt')))
    text = text.when(F.col("k") % 3 == 1, F.concat(F.lit("npm i --save @scope/lib"), s(F.col("k") % 7), F.lit("@^2."), s(F.col("k") % 4), F.lit(" left-pad; ls | wc")))
    return e.select("event_id", text.otherwise(F.concat(F.lit("cargo add crate"), s(F.col("k") % 6), F.lit("@=0."), s(F.col("k") % 8))).alias("command"))


_PACKAGES = """packages AS (SELECT event_id, 'pkg' || (k % 9) AS name, '1.' || (k % 5) || '.0' AS version, 'PyPI' AS ecosystem, true AS exact FROM ev WHERE k % 3 = 0
  UNION ALL SELECT event_id, '@scope/lib' || (k % 7), '^2.' || (k % 4), 'npm', false FROM ev WHERE k % 3 = 1
  UNION ALL SELECT event_id, 'left-pad', NULL, 'npm', false FROM ev WHERE k % 3 = 1
  UNION ALL SELECT event_id, 'crate' || (k % 6), '0.' || (k % 8), 'crates.io', true FROM ev WHERE k % 3 = 2)"""
_EVENTS = "ev AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def vulnerabilities(spark):
    n = spark.range(6)
    s = F.col("id").cast("string")
    pip = n.select(F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("pkg"), s).alias("name"), F.lit("1.0.0").alias("version"), F.concat(F.lit("V-"), s).alias("id"))
    return pip.unionByName(spark.createDataFrame([("npm", "left-pad", "1.3.0", "V-L")], "ecosystem string, name string, version string, id string"))


def latest(spark):
    n = spark.range(9).select(F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("pkg"), F.col("id").cast("string")).alias("name"), F.lit("1.4.0").alias("version"))
    return n.unionByName(spark.createDataFrame([("npm", "left-pad", "1.3.0")], "ecosystem string, name string, version string"))


def checked(spark, sf_dir):
    found = deps.checked(deps.command_packages(commands(spark, sf_dir)).drop("command"), vulnerabilities(spark), latest(spark))
    return found.select("event_id", "ecosystem", "name", "version", "effective", "ids", "decision", "update_to")


PLANS = {
    "dep3_4_5_command_packages": (
        lambda s, d: deps.command_packages(commands(s, d)).drop("command"),
        f"WITH {_EVENTS}, {_PACKAGES} SELECT * FROM packages",
    ),
    "dep7_exact_versions": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "^").otherwise(""), F.col("p_size").cast("string"), F.lit(".1")).alias("spec")).select("p_partkey", "spec", deps.exact_version_column(F.col("spec")).alias("exact")),
        "SELECT p_partkey, spec, NOT starts_with(spec, '^') AS exact FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '^' ELSE '' END || p_size || '.1' AS spec FROM part)",
    ),
    "jon7_dep11_12_checked_packages": (
        checked,
        f"""WITH {_EVENTS}, {_PACKAGES}, l AS (SELECT *, CASE ecosystem WHEN 'PyPI' THEN '1.4.0' WHEN 'npm' THEN CASE WHEN name = 'left-pad' THEN '1.3.0' END END AS latest FROM packages),
        e AS (SELECT *, CASE WHEN exact THEN version WHEN version IS NULL THEN latest END AS effective FROM l),
        v AS (SELECT *, CASE WHEN ecosystem = 'PyPI' AND effective = '1.0.0' AND name IN ('pkg0', 'pkg1', 'pkg2', 'pkg3', 'pkg4', 'pkg5') THEN 'V-' || substr(name, 4) WHEN name = 'left-pad' AND effective = '1.3.0' THEN 'V-L' ELSE '' END AS ids FROM e)
        SELECT event_id, ecosystem, name, version, effective, ids, CASE WHEN ids <> '' THEN 'block' ELSE 'allow' END AS decision, CASE WHEN ids = '' AND exact AND latest IS NOT NULL AND version <> latest THEN latest END AS update_to FROM v""",
    ),
}
