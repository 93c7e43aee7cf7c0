"""Mixing sources to target weights by iterative proportional fitting.

Each document falls into a cell (source, language, topic); the cells' token counts are raked until their marginals meet
the target shares of sources, languages and topics. A document is then kept with the calibrated probability of its cell,
scaled so that the expected number of kept tokens is the budget (no probability exceeds 1; what capped cells lack, the
others make up), by a hash of its doc_id: the same documents on every run.

Topics come from a column expression, by default from the first of TOPICS' rules that matches the text, so one pass over
the texts gives cell and tokens. Documents are aggregated to cells before any shuffle, so a source with a third of all rows
is one row of each task. Cells are raked on the driver up to DRIVER_CELLS cells, beyond that as a table, by the same steps
and to the same scale. Raking ends when no marginal is off by more than TOLERANCE, or after ROUNDS rounds; marginals that
are then off by more than ACCEPTED (targets that the cells can't meet) give a warning, and marginals() shows them all.

Targets not given are the corpus's own shares to the power `temper` (1: as they are, 0: all alike), normalised. Targets
given are normalised over the values that occur; values without a target get nothing.

Defined cases: null source or language is a value of its own, written as ''; null or empty texts have 0 tokens and are
kept with the probability of their cell (cells without tokens: the budget); null doc_ids hash as ''; rows of equal doc_id
are kept or dropped together within a cell; very long texts are counted whole; extra columns are ignored or kept, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

DRIVER_CELLS = 100_000
ROUNDS = 24
TOLERANCE, ACCEPTED = 1e-15, 1e-6
DIMENSIONS = ("source", "lang", "topic")
#: Topics by the first rule that holds: name and strings of which one occurs.
TOPICS = (("legal", ("icensed under", "Released under", "opyright")), ("contact", ("@", "+1 ")), ("table", (" | ",)), ("markup", ("%%%", "&&&", "$$$", "###")))
OTHER_TOPIC = "prose"
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
BUDGET = 0.75


def topic_of(text: Column) -> Column:
    out = F.lit(OTHER_TOPIC)
    for name, needles in reversed(TOPICS):
        hit = F.lit(False)
        for x in needles:
            hit = hit | F.contains(text, F.lit(x))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def weighed(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of every document; `topic`: an expression over its columns in place of the rules."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), _topic(topic).alias("topic"), tokens_of(text).alias("n_tokens"))


def _topic(topic: Column | None) -> Column:
    return topic_of(F.coalesce("text", F.lit(""))) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))


def _shares(totals: dict[str, float], target: dict[str, float] | None, temper: float) -> dict[str, float]:
    t = {k: (target.get(k, 0.0) if target else v**temper if v > 0 else 0.0) for k, v in totals.items()}
    t = {k: v if totals[k] > 0 else 0.0 for k, v in t.items()}
    s = math.fsum(t[k] for k in sorted(t))
    return {k: v / s if s else 0.0 for k, v in t.items()}


def rake(cells: list[tuple[str, str, str]], tokens: np.ndarray, targets: dict, temper: dict, rounds: int) -> np.ndarray:
    """Each cell's factor: raked share over its own share."""
    total = float(tokens.sum())
    x = tokens / total if total else np.zeros(len(tokens))
    for _ in range(rounds):
        off = 0.0
        for d, name in enumerate(DIMENSIONS):
            values = sorted({c[d] for c in cells})
            at = np.array([values.index(c[d]) for c in cells]) if len(values) < 64 else np.searchsorted(np.array(values), np.array([c[d] for c in cells]))
            own = np.bincount(at, weights=tokens, minlength=len(values))
            want = _shares(dict(zip(values, own.tolist())), targets.get(name), temper.get(name, 1.0))
            have = np.bincount(at, weights=x, minlength=len(values))
            goal = np.array([want[v] for v in values])
            off = max(off, float(np.abs(have - goal).max(initial=0.0)))
            x = x * (goal / np.where(have > 0, have, 1))[at]
        if off <= TOLERANCE:
            break
    else:
        _warn(off if total else 0.0)
    return np.where(tokens > 0, x * total / np.where(tokens > 0, tokens, 1), 0.0)


def _warn(off: float) -> None:
    if off > ACCEPTED:
        warnings.warn(f"marginals are off by up to {off:.3g} after the last round: the cells can't meet these targets", stacklevel=3)


def scale_for(pairs: list[tuple[float, float]], budget: float) -> float:
    """The factor by which probabilities are scaled; pairs: (factor, tokens). Those of 1 or more are cut to 1."""
    rest = sum(t for f, t in pairs if f > 0)
    want, done = min(budget * sum(t for _, t in pairs), rest), 0.0
    mass = math.fsum(f * t for f, t in pairs)
    for f, t in sorted((p for p in pairs if p[0] > 0), reverse=True):
        if mass <= 0:
            break
        lam = (want - done) / mass
        if lam * f < 1:
            return lam
        done, mass = done + t, mass - f * t
    return max((1 / f for f, _ in pairs if f > 0), default=0.0)


def _rake_table(cells: DataFrame, targets: dict, temper: dict, rounds: int) -> DataFrame:
    """The same as rake(), for any number of cells: (source, lang, topic, tokens, factor)."""
    x = materialize(cells.withColumn("x", F.col("tokens").cast("double")), "mixture-cells")
    wants = {}
    for name in DIMENSIONS:
        own = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("own"))
        if targets.get(name):
            t = cells.sparkSession.createDataFrame(list(targets[name].items()), f"{name} string, w double")
            own = own.join(t, name, "left").withColumn("w", F.when(F.col("own") > 0, F.coalesce("w", F.lit(0.0))).otherwise(0.0))
        else:
            own = own.withColumn("w", F.when(F.col("own") > 0, F.pow("own", F.lit(temper.get(name, 1.0)))).otherwise(0.0))
        total = own.agg(F.sum("w")).first()[0] or 0.0
        wants[name] = materialize(own.select(name, (F.col("w") / F.lit(total) if total else F.lit(0.0)).alias("want")), "mixture-target")
    all_ = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for _ in range(rounds):
        gaps = []
        for name in DIMENSIONS:
            have = x.groupBy(name).agg(F.sum("x").alias("have"))
            gaps.append(have.join(wants[name], name).agg(F.max(F.abs(F.col("have") / F.lit(all_ or 1.0) - F.col("want"))).alias("off")))
            f = have.join(wants[name], name).select(name, F.when(F.col("have") > 0, F.col("want") * F.lit(all_) / F.col("have")).otherwise(0.0).alias("f"))
            x = x.join(f, name).withColumn("x", F.col("x") * F.col("f")).drop("f")
        x = materialize(x.select(*DIMENSIONS, "tokens", "x"), "mixture-cells")
        off = max((g.first()[0] or 0.0) for g in gaps)
        if off <= TOLERANCE:
            break
    else:
        _warn(off if rounds else 0.0)
    return x.withColumn("factor", F.when(F.col("tokens") > 0, F.col("x") / F.col("tokens")).otherwise(0.0)).drop("x")


def _scale_table(cells: DataFrame, budget: float) -> float:
    """scale_for() over the table: bisection tells which cells are cut to 1, the others share out the rest."""
    total, top, low = cells.agg(F.sum("tokens"), F.max("factor"), F.min(F.when(F.col("factor") > 0, F.col("factor")))).first()
    if not total or not top:
        return 0.0
    lo, hi = 0.0, 1 / low
    for _ in range(60):
        mid = (lo + hi) / 2
        got = cells.agg(F.sum(F.least(F.lit(1.0), F.col("factor") * F.lit(mid)) * F.col("tokens"))).first()[0]
        lo, hi = (mid, hi) if got < budget * total else (lo, mid)
    cut = F.col("factor") * F.lit(hi) >= 1
    done, mass, able = cells.agg(F.sum(F.when(cut, F.col("tokens"))), F.sum(F.when(~cut, F.col("factor") * F.col("tokens"))), F.sum(F.when(F.col("factor") > 0, F.col("tokens")))).first()
    want = min(budget * total, float(able))
    return (want - (done or 0)) / mass if mass and want > (done or 0) else hi


def cell_probabilities(docs: DataFrame, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, rounds: int = ROUNDS, topic: Column | None = None) -> DataFrame:
    """(source, lang, topic, prob) of every cell that occurs.

    `targets`: by dimension, the wanted share of each value; `budget`: the share of all tokens to keep.
    """
    spark = docs.sparkSession
    targets, temper = targets or {}, TEMPER if temper is None else temper
    cells = materialize(weighed(docs, topic).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mixture-cells")
    if cells.count() <= DRIVER_CELLS:
        got = sorted((r.source, r.lang, r.topic, r.tokens) for r in cells.collect())
        tokens = np.array([r[3] for r in got], np.float64)
        factor = rake([r[:3] for r in got], tokens, targets, temper, rounds) if got else tokens
        lam = scale_for(list(zip(factor.tolist(), tokens.tolist())), budget)
        prob = np.where(tokens > 0, np.minimum(1.0, lam * factor), budget)
        table = spark.createDataFrame([(*r[:3], float(p)) for r, p in zip(got, prob)], "source string, lang string, topic string, prob double")
        return F.broadcast(table)  # DRIVER_CELLS rows at most
    raked = _rake_table(cells, targets, temper, rounds)
    lam = _scale_table(raked, budget)
    return raked.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("factor") * F.lit(lam))).otherwise(F.lit(budget)).alias("prob"))


def mixture(docs: DataFrame, seed: int = 1, topic: Column | None = None, **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, prob (to 9 digits) and sampled of every document; options as above."""
    rows = weighed(docs, topic).join(cell_probabilities(docs, topic=topic, **options), list(DIMENSIONS))
    prob = F.round("prob", 9)
    return rows.select("doc_id", *DIMENSIONS, "n_tokens", prob.alias("prob"), (draw(F.col("doc_id"), seed) < prob).alias("sampled"))


def marginals(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, **options) -> DataFrame:
    """(dimension, value, own, reached): each value's share of all tokens, and of the tokens that are expected to be kept."""
    rows = weighed(docs, topic).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).join(cell_probabilities(docs, targets=targets, topic=topic, **options), list(DIMENSIONS))
    kept = F.col("tokens") * F.col("prob")
    cells = materialize(rows.select(*DIMENSIONS, "tokens", kept.alias("kept")), "mixture-marginals")
    total = cells.agg(F.sum("tokens").alias("a"), F.sum("kept").alias("b")).first()
    share = lambda c, all_: F.sum(c) / F.lit(float(all_ or 1))
    out = [cells.groupBy(F.col(d).alias("value")).agg(share("tokens", total.a).alias("own"), share("kept", total.b).alias("reached")).select(F.lit(d).alias("dimension"), "value", "own", "reached") for d in DIMENSIONS]
    return out[0].unionByName(out[1]).unionByName(out[2])


def sample_documents(docs: DataFrame, seed: int = 1, topic: Column | None = None, **options) -> DataFrame:
    """The documents that the mixture keeps, with all their columns.

    A row's cell follows from the row alone, so rows are marked where they stand: no join on doc_id.
    """
    keyed = docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"), "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), _topic(topic).alias("topic"))
    kept = keyed.join(cell_probabilities(docs, topic=topic, **options), list(DIMENSIONS)).where(draw(F.col("doc_id"), seed) < F.round("prob", 9))
    return kept.select("row.*")


def oracle(rounds: int = ROUNDS, budget: float = BUDGET, seed: int = 1) -> str:
    """The mixture of `documents` with its default targets, as DuckDB SQL."""
    topic = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {_quote(x)})' for x in needles)} THEN '{name}'" for name, needles in TOPICS) + f" ELSE '{OTHER_TOPIC}' END"
    out = [
        "w AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, "
        f"{topic} AS topic, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE / sum(sum(n_tokens)) OVER () AS x FROM w GROUP BY ALL)",
    ]
    for name in DIMENSIONS:
        out.append(f"t_{name} AS MATERIALIZED (SELECT {name}, p / sum(p) OVER () AS want FROM (SELECT {name}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {TEMPER[name]}) ELSE 0 END AS p FROM c0 GROUP BY {name}))")
    k = 0
    for _ in range(rounds):
        for name in DIMENSIONS:
            k += 1
            out.append(f"c{k} AS MATERIALIZED (SELECT source, lang, topic, tokens, x * want / coalesce(nullif(sum(x) OVER (PARTITION BY {name}), 0), 1) AS x FROM c{k - 1} JOIN t_{name} USING ({name}))")
    out += [
        f"f AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN x * sum(tokens) OVER () / tokens ELSE 0 END AS f FROM c{k})",
        # cells by falling factor: what the ones before hold if they are cut to 1, and what is left to share out
        "g AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, "
        "sum(f * tokens) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass, "
        f"least({budget} * sum(tokens) OVER (), sum(CASE WHEN f > 0 THEN tokens ELSE 0 END) OVER ()) AS want FROM f)",
        "l AS (SELECT coalesce((SELECT (want - done) / mass FROM g WHERE f > 0 AND mass > 0 AND (want - done) / mass * f < 1 ORDER BY f DESC, source, lang, topic LIMIT 1), (SELECT max(1 / f) FROM g WHERE f > 0), 0) AS lam)",
        f"p AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN least(1.0, lam * f) ELSE {budget} END, 9) AS prob FROM g, l)",
    ]
    draw_sql = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {1 << 52}.0"
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, source, lang, topic, n_tokens, prob, {draw_sql} < prob AS sampled FROM w JOIN p USING (source, lang, topic)"


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"
