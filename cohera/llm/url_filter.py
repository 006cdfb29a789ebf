"""URL filter: rules first, then the ratio of two character language models.

A rule is a host and a path prefix; it fits that host and its subdomains,
and the longest fitting rule decides. The rules' verdicts label the URLs
they fit: accepted and rejected. Each class gets a smoothed variable-order
Markov model over characters (UTF-8 bytes; contexts of 0 to ``ORDER``,
interpolated by Witten-Bell). A URL that no rule fits is judged by the
difference of its two log-likelihoods per character, against a threshold
calibrated on labelled URLs that the models did not count.

Counts are a Spark table over all labelled URLs, a row per order, context and
character. These three are the key itself, packed into 56 bits and not
hashed, so counts are exact and the table grows with the corpus. Up to
``MAX_BROADCAST`` bytes it is broadcast; beyond, the distinct keys of the
URLs are joined to it, order by order.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import materialized, text_batches

ORDER = 5
#: the table of counts is broadcast up to this size, else joined
MAX_BROADCAST = 64 << 20
#: characters of the URLs of one piece where the table is joined
PIECE = 1 << 20
#: one labelled URL in so many is kept for calibration
CALIBRATE = 5
#: thresholds tried: this many per unit of log-likelihood difference per character
GRID = 200
#: (rule, verdict); a rule is a host and the start of a path
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
         ("com/de/", "block"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_for(host_: Column, path_: Column, rules: Iterable[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = text.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def slots(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, keys of contexts, keys of continuations) for every character and order.

    Key matrices have a row per order; a context that would reach before the
    text's start holds a start mark instead, which is a context too. A
    context is its order and 9 bits a character, the nearest lowest; a
    continuation is a context and the character that follows.
    """
    n = len(buf)
    doc = np.searchsorted(offs, np.arange(n), side="right") - 1
    inside = np.arange(n) - offs[doc]
    char = buf.astype(np.int64)
    code = np.zeros(n, np.int64)
    ctx = np.empty((ORDER + 1, n), np.int64)
    for k in range(ORDER + 1):
        if k:
            before = np.full(n, 256, np.int64)
            before[k:] = char[:-k]
            before[inside < k] = 256
            code = code | before << 9 * (k - 1)
        ctx[k] = code | k << 45
    return doc, ctx, ctx << 8 | char


def _shorter(con: np.ndarray | Column, k: int) -> np.ndarray | Column:
    """The continuation of order ``k`` that one of a higher order ends in."""
    low = (1 << 9 * k + 8) - 1
    if isinstance(con, Column):
        return con.bitwiseAND(F.lit(low)).bitwiseOR(F.lit(k << 53))
    return con & low | k << 53


class Counts:
    """Counts of the labelled URLs.

    ``follows``: con, n0, n1: how often a continuation was seen in rejected
    and in accepted URLs. ``seen``: ctx, c0, c1, d0, d1: how often a context
    was, and how many distinct characters followed it.
    """

    def __init__(self, follows: DataFrame):
        self.follows = materialized(follows)
        self.seen = self.follows.groupBy(F.shiftright("con", 8).alias("ctx")).agg(
            F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), F.sum((F.col("n0") > 0).cast("bigint")).alias("d0"),
            F.sum((F.col("n1") > 0).cast("bigint")).alias("d1"))
        self.arrays = None
        if self.follows.count() * 64 <= MAX_BROADCAST:  # bytes of a continuation and, at most, a context
            con, ctx = self.follows.orderBy("con").toArrow(), self.seen.orderBy("ctx").toArrow()
            self.arrays = (con["con"].to_numpy(), np.stack([con[c].to_numpy() for c in ("n0", "n1")]), ctx["ctx"].to_numpy(),
                           np.stack([np.stack([ctx[f"{x}{y}"].to_numpy() for y in (0, 1)]) for x in "cd"]))

    def __getitem__(self, at):
        """(class, kind, key); kinds are 0: times a context was seen, 1: times a
        character followed it, 2: distinct characters that followed it."""
        side, kind, key = at
        con, n, ctx, seen = self.arrays
        return _at(con, n[side], key) if kind == 1 else _at(ctx, seen[kind // 2, side], key)


def _at(keys: np.ndarray, values: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The values of some keys, 0 where a key is not there; ``keys`` are in order."""
    if not len(keys):
        return np.zeros(np.shape(key), np.int64)
    i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[i] == key, values[i], 0)


def train(urls: DataFrame, url_col: str = "url", verdict_col: str = "verdict") -> Counts:
    """Counts of the labelled URLs, class 0 rejected and 1 accepted."""
    known = urls.where(F.col(verdict_col).isNotNull()).select(
        F.col(url_col).alias("url"), (F.col(verdict_col) == "allow").cast("int").alias("y"))

    def count(batches):
        for part, buf, offs in text_batches(batches, "url", PIECE):
            y = part.column(part.schema.get_field_index("y")).to_numpy()
            doc, _, con = slots(buf, offs)
            key, n = np.unique((con << 1 | y[doc]).ravel(), return_counts=True)
            bad = key & 1 == 0
            yield pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(np.where(bad, n, 0)), pa.array(np.where(bad, 0, n))],
                                             ["con", "n0", "n1"])

    return Counts(known.mapInArrow(count, "con bigint, n0 bigint, n1 bigint")
                  .groupBy("con").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def _differences(table: Counts, con: np.ndarray) -> np.ndarray:
    """Accepted minus rejected log-likelihood of continuations of the highest order."""
    logs = []
    for side in (0, 1):
        p = np.full(len(con), 1 / 257)
        for k in range(ORDER + 1):
            key = _shorter(con, k)
            c, d, f = table[side, 0, key >> 8], table[side, 2, key >> 8], table[side, 1, key]
            p = np.where(c > 0, (f + d * p) / np.maximum(c + d, 1), p)
        logs.append(np.log(np.maximum(p, 1e-12)))
    return logs[1] - logs[0]


def _joined_differences(table: Counts, con: DataFrame) -> DataFrame:
    """(con, value): ``_differences`` of the distinct keys ``con`` by joins.

    From order 0 up each continuation takes the probabilities of the one it
    ends in. At most 257 continuations end in the same one, and at most 256
    have one context, so no key of a join is hot.
    """
    levels = [materialized(con.select("con").distinct())]
    for k in range(ORDER - 1, -1, -1):
        levels.append(materialized(levels[-1].select(_shorter(F.col("con"), k).alias("con")).distinct()))
    seen, p = materialized(table.seen), None
    for k, level in enumerate(reversed(levels)):
        x = level.withColumn("ctx", F.shiftright("con", 8)).join(seen, "ctx", "left").join(table.follows, "con", "left")
        if k:
            x = x.withColumn("up", _shorter(F.col("con"), k - 1)).join(p, "up", "left")
        else:
            x = x.withColumns({"p0": F.lit(1 / 257), "p1": F.lit(1 / 257)})

        def step(y: int) -> Column:
            f, c, d = (F.coalesce(F.col(f"{v}{y}"), F.lit(0)) for v in "ncd")
            return F.when(c > 0, (f + d * F.col(f"p{y}")) / (c + d)).otherwise(F.col(f"p{y}"))
        p = materialized(x.select(F.col("con").alias("up"), step(0).alias("p0"), step(1).alias("p1")))
    log = [F.log(F.greatest(F.col(c), F.lit(1e-12))) for c in ("p0", "p1")]
    return p.select(F.col("up").alias("con"), (log[1] - log[0]).alias("value"))


def _mean(doc: np.ndarray, value: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """Mean value of each text's characters; 0 for texts without characters."""
    return np.bincount(doc, value, minlength=n) / np.maximum(np.diff(offs), 1)


def score(urls: DataFrame, table: Counts, url_col: str = "url", out_col: str = "difference") -> DataFrame:
    """``urls`` with the log-likelihood difference per character."""
    keep = [c for c in urls.columns if c != out_col]
    fields = [*[f for f in urls.schema.fields if f.name in keep], StructField(out_col, DoubleType())]

    def scored(part, buf, offs, values):
        doc, _, con = slots(buf, offs)
        key, at = np.unique(con[ORDER], return_inverse=True)
        d = _mean(doc, values(key)[at], offs, part.num_rows)
        cols = [part.column(part.schema.get_field_index(c)) for c in keep]
        return pa.RecordBatch.from_arrays([*cols, pa.array(d, pa.float64())], [*keep, out_col])

    if table.arrays is not None:
        shipped = urls.sparkSession.sparkContext.broadcast(table.arrays)

        def run(batches):
            own = Counts.__new__(Counts)
            own.arrays = shipped.value
            for part, buf, offs in text_batches(batches, url_col, PIECE):
                yield scored(part, buf, offs, lambda key: _differences(own, key))

        return urls.mapInArrow(run, StructType(fields))

    size = urls.agg(F.sum(F.octet_length(F.col(url_col)))).first()[0] or 0
    piece = F.pmod(F.xxhash64(*[F.col(c) for c in keep]), F.lit(size // PIECE + 1))
    dealt = materialized(urls.select(*keep, piece.alias("_piece")))

    def ask(batches):
        for part, buf, offs in text_batches(batches, url_col, PIECE):
            _, _, con = slots(buf, offs)
            own = part.column(part.schema.get_field_index("_piece")).to_numpy()
            at = np.repeat(own, np.diff(offs))
            both = np.unique(np.stack([at, con[ORDER]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["of", "con"])

    asked = materialized(dealt.mapInArrow(ask, "of bigint, con bigint").distinct())
    answers = asked.join(_joined_differences(table, asked), "con")

    def told(part: pa.Table, answer: pa.Table) -> pa.Table:
        order = np.argsort(answer["con"].to_numpy())
        keys, values = answer["con"].to_numpy()[order], answer["value"].to_numpy()[order]
        rows = part.combine_chunks().to_batches()
        return pa.Table.from_batches([scored(*piece, lambda key: _at(keys, values, key))
                                      for piece in text_batches(rows, url_col, 1 << 40)], out_schema(part))

    def out_schema(part: pa.Table) -> pa.Schema:
        return pa.schema([*[part.schema.field(c) for c in keep], pa.field(out_col, pa.float64())])

    return dealt.groupBy("_piece").cogroup(answers.groupBy("of")).applyInArrow(told, StructType(fields))


def calibrate(scored: DataFrame, verdict_col: str = "verdict", diff_col: str = "difference") -> float:
    """The threshold with the best balanced accuracy on labelled URLs; 0 without both classes.

    A histogram of ``GRID`` cells per unit reaches the driver, not the URLs.
    """
    cell = F.greatest(F.least(F.round(F.col(diff_col) * GRID), F.lit(20 * GRID)), F.lit(-20 * GRID)).cast("int")
    rows = (scored.where(F.col(verdict_col).isNotNull()).groupBy(cell.alias("cell"))
            .agg(F.sum((F.col(verdict_col) == "allow").cast("int")).alias("good"), F.count(F.lit(1)).alias("n")).collect())
    good, bad = sum(r["good"] for r in rows), sum(r["n"] - r["good"] for r in rows)
    if not good or not bad:
        return 0.0
    best, at, g, b, below = -1.0, 0.0, good, 0, None
    for r in sorted(rows, key=lambda r: r["cell"]):  # everything below the threshold is rejected
        value, middle = g / good + b / bad, r["cell"] - 0.5 if below is None else (r["cell"] + below) / 2
        if value > best or (value == best and abs(middle) < abs(at)):
            best, at = value, middle
        g, b, below = g - r["good"], b + r["n"] - r["good"], r["cell"]
    return at / GRID


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, difference.

    Null URLs, and those without ``://``, have an empty host and path; no
    rule fits them. A URL without characters has difference 0. Without
    labelled URLs of both classes the threshold is 0. Repeated rows are
    judged each; an empty table gives no rows.
    """
    x = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"),
                     path(F.col(url_col)).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), list(rules))
    x = x.withColumns({"rule": rule, "verdict": verdict})
    held = F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(CALIBRATE)) == 0
    x = x.withColumn("text", F.regexp_replace(F.coalesce("url", F.lit("")), r"^(?s:.*?)://", ""))
    table = train(x.where(~held), "text")
    limit = calibrate(score(x.where(held & F.col("verdict").isNotNull()).select("page_id", "verdict", "text"), table, "text"))
    out = score(x, table, "text")
    says = F.when(F.col("difference") >= F.lit(limit), F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", says).alias("verdict"), "difference")
