"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic, weighted by tokens. The
cells' weights are raked: scaled to each margin's target shares in turn, never above what a
cell has, until the margins agree. A cell's raked weight over its tokens is the probability
with which its documents are drawn. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.llm.common import Scratch, only, text_or_empty

MARGINS = ("source", "lang", "topic")
#: Target share of a margin's value: its share of tokens to this power, normalised.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Tokens to draw, as a part of all tokens.
PART = 0.7
#: Rounds of raking over all margins, and how many are planned as one job.
ROUNDS, AT_ONCE = 12, 3
NONE = "(none)"

#: Topics by the first marker that a text contains.
TOPICS = {"legal": ("icense", "ights reserved"), "secret": ("password=", "token ="), "table": (" | ",), "contact": ("@",)}
OTHER_TOPIC = "prose"


def topic(text: Column) -> Column:
    found = F.lit(OTHER_TOPIC)
    for name, markers in reversed(TOPICS.items()):
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains(text, F.lit(m))
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("bigint")


def draw(doc_id: str = "doc_id") -> Column:
    """A number from 0 to 1 that depends on the id alone; a null id counts as empty."""
    name = F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def _margins(docs: DataFrame) -> DataFrame:
    read = only(docs, "doc_id", "text", "source", "lang").withColumn("text", text_or_empty())
    return read.select(
        "doc_id", F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"),
        topic(F.col("text")).alias("topic"), tokens(F.col("text")).alias("tokens"),
    )


def rake(cells: DataFrame, scratch: Scratch, part: float = PART, temper: dict[str, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (margins, tokens) with their weight and probability."""
    temper = temper or TEMPER
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    weighted = cells
    for m in MARGINS:
        own = cells.groupBy(m).agg((F.sum("tokens") / F.lit(float(max(total, 1)))).alias("share"))
        power = F.pow("share", F.lit(temper[m]))
        scale = own.agg(F.sum(power)).first()[0] or 1.0
        target = own.select(m, (power / F.lit(scale) * F.lit(part * total)).alias(f"target_{m}"))
        weighted = weighted.join(target, m)
    weighted = scratch.table(weighted.withColumn("weight", F.col("tokens") * F.lit(part)), "raked-0")
    for done in range(0, rounds, AT_ONCE):
        for _ in range(min(AT_ONCE, rounds - done)):
            for m in MARGINS:
                there = F.sum("weight").over(Window.partitionBy(m))
                scaled = F.when(there > 0, F.col("weight") * F.col(f"target_{m}") / there).otherwise(F.col("weight"))
                weighted = weighted.withColumn("weight", F.least(scaled, F.col("tokens").cast("double")))
        weighted = scratch.table(weighted, f"raked-{done + AT_ONCE}")
        scratch.drop(f"raked-{done}")
    rate = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("tokens"))).otherwise(F.lit(part))
    return weighted.select(*MARGINS, F.col("tokens").alias("cell_tokens"), "weight", rate.alias("probability"))


def mix(docs: DataFrame, part: float = PART, temper: dict[str, float] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, tokens, probability, selected.

    Null source or language is a value of its own, named (none). Null and empty text has no
    tokens; a cell without tokens is drawn with probability ``part``. Rows are drawn by a
    hash of doc_id, so repeated rows share their lot. Targets that a cell's tokens cannot
    fill leave it whole. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.table(_margins(docs), "rows")
    cells = scratch.table(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    # As many rows as cells; a written table, so that its size is known when the join is planned.
    rates = scratch.table(rake(cells, scratch, part, temper).select(*MARGINS, "probability"), "rates")
    return rows.join(rates, list(MARGINS)).select(
        "doc_id", *MARGINS, "tokens", "probability", (draw() < F.col("probability")).alias("selected")
    )


def draw_mixture(docs: DataFrame, part: float = PART, temper: dict[str, float] | None = None) -> DataFrame:
    """The selected rows of ``docs``, columns unchanged."""
    scratch = Scratch(docs.sparkSession, "mixture")
    cells = scratch.table(_margins(docs).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    rates = scratch.table(rake(cells, scratch, part, temper).select(
        *[F.col(m).alias(f"_{m}") for m in MARGINS], F.col("probability").alias("_probability")
    ), "rates")
    marked = docs.withColumns({
        "_source": F.coalesce("source", F.lit(NONE)), "_lang": F.coalesce("lang", F.lit(NONE)),
        "_topic": topic(text_or_empty()), "_draw": draw(),
    })
    return marked.join(rates, [f"_{m}" for m in MARGINS]).filter("_draw < _probability").select(*docs.columns)


def twin(documents: str, part: float = PART, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL: common table expressions that end in ``drawn``."""
    cases = " ".join(
        f"WHEN {' OR '.join(f'''contains(t, '{m}')''' for m in markers)} THEN '{name}'" for name, markers in TOPICS.items()
    )
    steps = [f"""mix_rows AS (SELECT *, CASE {cases} ELSE '{OTHER_TOPIC}' END AS topic,
        len(regexp_extract_all(t, '[^ \\t-\\r]+'))::BIGINT AS tokens FROM (SELECT doc_id, coalesce(source, '{NONE}') AS source,
        coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS t FROM {documents}))""",
             "cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM mix_rows GROUP BY ALL)"]
    for m in MARGINS:
        steps.append(f"""share_{m} AS (SELECT {m}, pow(sum(tokens) / greatest((SELECT sum(tokens) FROM cells), 1)::DOUBLE, {TEMPER[m]}) AS p
            FROM cells GROUP BY {m})""")
        steps.append(f"""target_{m} AS (SELECT {m}, p / (SELECT sum(p) FROM share_{m}) * ({part} * (SELECT sum(tokens) FROM cells)) AS target_{m}
            FROM share_{m})""")
    steps.append(f"""w0 AS (SELECT *, tokens * {part}::DOUBLE AS weight FROM cells
        {' '.join(f'JOIN target_{m} USING ({m})' for m in MARGINS)})""")
    for k in range(rounds * len(MARGINS)):
        m = MARGINS[k % len(MARGINS)]
        steps.append(f"""w{k + 1} AS MATERIALIZED (SELECT * REPLACE (least(CASE WHEN there > 0 THEN weight * target_{m} / there ELSE weight END,
            tokens::DOUBLE) AS weight) FROM (SELECT w{k}.* EXCLUDE (there), sum(weight) OVER (PARTITION BY {m}) AS there FROM w{k}))"""
                     .replace(" EXCLUDE (there)", "" if k == 0 else " EXCLUDE (there)"))
    steps.append(f"""drawn AS (SELECT doc_id, r.source, r.lang, r.topic, r.tokens,
        CASE WHEN c.tokens > 0 THEN least(1.0, weight / c.tokens) ELSE {part} END::DOUBLE AS probability,
        ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(1 << 52)!r} AS u
        FROM mix_rows r JOIN w{rounds * len(MARGINS)} c USING (source, lang, topic))""")
    return ",\n".join(steps)
