"""Verbatim restatement: which texts contain which pieces, joined on grams instead of comparing all of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text

#: Fixed value: the shortest normalised piece that counts as a restatement.
LEAST = 40
GRAM = 16
#: Of so many of a piece's grams the rarest finds it.
KEYS = 8
#: Texts of a hot gram go to blocks of about so many.
BLOCK = 20_000


def selected_grams(normal: str, gram: int, window: int) -> np.ndarray:
    """Hashes of the grams that are smallest in some window of `window` grams. A stretch of gram + window - 1 characters
    has the same ones wherever it stands, so a text that contains a piece has all of the piece's."""
    code = np.frombuffer(normal.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(code) - gram + 1
    if n < window:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(gram):
        out = (out ^ code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    least = out[: n - window + 1].copy()
    for k in range(1, window):
        np.minimum(least, out[k : n - window + 1 + k], out=least)
    return np.unique(least).astype(np.int64)


def grams(rows: DataFrame, id_col: str, text_col: str, least: int = LEAST, gram: int = GRAM, most: int | None = None, with_col: str | None = None) -> DataFrame:
    """(id, gram) of texts that are normalised already; null and shorter texts have none. most: so many of each text's are
    enough, spread evenly; with_col: a column that comes along as scope."""
    kept = [id_col, *([with_col] if with_col else [])]
    kinds = [f"{n} {rows.schema[c].dataType.simpleString()}" for n, c in zip(("id", "scope"), kept, strict=False)]

    def some(found: np.ndarray) -> np.ndarray:
        return found if most is None or len(found) <= most else found[np.linspace(0, len(found) - 1, most).astype(np.int64)]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [some(selected_grams(t, gram, least - gram + 1)) if t else np.zeros(0, np.int64) for t in batch.column(0).to_pylist()]
            of = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]))
            columns = [batch.column(i + 1).take(of) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], names=["id", "scope"][: len(kept)] + ["gram"])

    return rows.select(text_col, *kept).mapInArrow(work, ", ".join([*kinds, "gram long"]))


def containing(texts: DataFrame, pieces: DataFrame, least: int = LEAST, everywhere: bool = True) -> DataFrame:
    """(text_id, piece_id): which texts contain which pieces of their scope.

    texts: text_id, scope, normal; pieces: piece_id, scope, piece (at least `least` characters; shorter ones are not
    found). Both are normalised. A piece of null scope is looked for in all texts; a text of null scope is found by such
    pieces alone; without `everywhere` pieces of null scope are not looked for, which halves the keys. A text that contains a
    piece has all its selected grams, so any one of them finds it: each piece is keyed by that of eight of them which the
    fewest texts of its scope have; a piece with a gram that no text has is in none. Texts meet it on that key only, those of a hot key in blocks, and whoever meets
    is compared in full. Grams repeat within a text once, so keys cost about a tenth of a text's characters.
    """
    scoped = lambda gram, scope: F.xxhash64(gram, F.coalesce(scope.cast("string"), F.lit("")), scope.isNull())
    if not everywhere:
        texts, pieces = texts.where("scope is not null"), pieces.where("scope is not null")
    in_text = grams(texts, "text_id", "normal", least, with_col="scope")
    own = scoped(F.col("gram"), F.col("scope"))
    key = F.explode(F.array_distinct(F.array(own, scoped(F.col("gram"), F.lit(None).cast("string"))))) if everywhere else own
    in_text = in_text.select(F.col("id").alias("text_id"), key.alias("key"))
    in_piece = grams(pieces, "piece_id", "piece", least, most=KEYS, with_col="scope").select(F.col("id").alias("piece_id"), own.alias("key"))

    asked = in_text.join(in_piece.select("key").distinct(), "key", "left_semi")
    held = asked.groupBy("key").agg(F.count("*").alias("texts"))
    rarest = in_piece.join(held, "key", "left").groupBy("piece_id").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "key")).alias("rarest"))
    rarest = rarest.where("rarest.texts > 0").select("piece_id", "rarest.key", F.ceil(F.col("rarest.texts") / BLOCK).alias("blocks"))
    wanted = rarest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    dealt = asked.join(rarest.select("key", "blocks").distinct(), "key").select("text_id", "key", F.pmod(F.xxhash64("text_id"), F.col("blocks")).alias("block"))
    met = dealt.join(wanted, ["key", "block"]).select("text_id", "piece_id")
    rows = met.join(pieces.select("piece_id", "piece"), "piece_id").join(texts.select("text_id", "normal"), "text_id")
    return rows.where(F.contains("normal", F.col("piece"))).select("text_id", "piece_id")


def _pieces(rows: DataFrame, scope: Column, body: Column, about: Column) -> DataFrame:
    """(piece_id, scope, piece, about): distinct pieces of a scope with the least of what they are about."""
    found = rows.select(scope.alias("scope"), about.alias("about"), F.explode(text.restatable(body, LEAST)).alias("piece"))
    found = found.groupBy("scope", "piece").agg(F.min("about").alias("about"))
    return found.withColumn("piece_id", F.sha2(F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("in "), F.col("scope").cast("string")), F.lit("all")), "piece").cast("binary"), 256))


def restating_checkpoints(roots: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(record, cause): the checkpoints that contain a root's body or one of its long sentences verbatim, case and white
    space aside, without citing it; cause is the first root. Checkpoints are looked at in the root's workstream, for a
    root without one everywhere.

    Both: seq, workstream_id, body. Null bodies restate nothing, repeated rows and equal pieces count once, a checkpoint
    that is a root itself may restate itself.
    """
    pieces = _pieces(roots, F.col("workstream_id"), F.col("body"), F.col("seq"))
    texts = checkpoints.where("body is not null").select(F.col("seq").alias("text_id"), F.col("workstream_id").alias("scope"), text.normalise_echo(F.col("body")).alias("normal"))
    found = containing(texts, pieces).join(pieces.select("piece_id", "about"), "piece_id")
    return found.groupBy(F.col("text_id").alias("record")).agg(F.min("about").alias("cause"))


def restated_echoes(shown: DataFrame, messages: DataFrame) -> DataFrame:
    """(branch, line, record): the records shown earlier on a branch that a message of the branch restates.

    shown: branch, line, record, body; messages: branch, line, text. A record counts from the first line that shows it
    on; only later lines restate it. Null texts restate nothing; a message without restatements has no row; repeated rows
    count once. The pieces of a record are found once for all branches that show it and looked for in each branch.
    """
    first = shown.where("body is not null and branch is not null").groupBy("branch", "record").agg(F.min("line").alias("since"), F.min_by("body", "line").alias("body"))
    held = first.select("branch", "record", "since", F.explode(text.restatable(F.col("body"), LEAST)).alias("piece"))
    # 16 bytes of the digest: ids go with every gram.
    held = held.withColumn("piece_id", F.substring(F.unhex(F.sha2(F.concat_ws("\x1f", F.col("branch").cast("string"), "piece").cast("binary"), 256)), 1, 16))
    pieces = held.select("piece_id", F.col("branch").alias("scope"), "piece").distinct()
    said = messages.where("text is not null").select("branch", "line", F.struct("branch", "line").alias("text_id"), F.col("branch").alias("scope"), text.normalise_echo(F.col("text")).alias("normal"))
    said = said.dropDuplicates(["branch", "line"])
    found = containing(said.select("text_id", "scope", "normal"), pieces, everywhere=False)
    rows = found.join(held.select("piece_id", "record", "since"), "piece_id")
    return rows.where(F.col("since") < F.col("text_id.line")).select("text_id.branch", "text_id.line", "record").distinct()
