"""Preparing a corpus: five stages, each over all that the one before has kept.

Each stage is a function of (spark, docs, sf_dir). ``run`` writes what a stage gives as
Parquet to the shared folder and reads it again for the next.

1. Documents that the quality classifier rejects go.
2. Of documents whose texts are nearly alike one stays, the one of the smallest id.
3. Bytes go that a string of 100 bytes covers which an earlier document has.
4. The sources are mixed to their targets. A document may be taken up to twice; of the
   one at the cut of its source only as many words are taken as the budget has left.
5. Texts become token ids.

Nulls: a null text is an empty one, and stays null where its document stays; null ids
come last where ids order; a null source is a source of its own. Documents that are
alike in all columns count as copies. Extra columns are carried along, whatever their
names. An empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernwork.llm.bpe import encode_proved
from quernwork.llm.common import bounded_batches, durable, free_name, stored
from quernwork.llm.mixing import WORD, mix, random_key, words
from quernwork.llm.near_copies import proved_roots, sketch
from quernwork.llm.q03_bpe import VOCABULARY
from quernwork.llm.q06_quality import fitted
from quernwork.llm.quality import THRESHOLD, score
from quernwork.llm.repeats import readable, remove_repeats
from quernwork.sources import Tables

# Near copies share 0.8 or more of their distinct shingles of five words. Fingerprints of
# 192 bits then differ in 29 bits on average, those of texts that share nothing in 96; they
# only say which texts are compared.
SHINGLE = 5
PRINT_WORDS = 3
PRINT_BITS = 48


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns called c0, c1 and so on, and what each was called."""
    names = {f"c{i}": name for i, name in enumerate(docs.columns)}
    return docs.toDF(*names), names


def _of(names: dict[str, str], wanted: str) -> str:
    return next(new for new, old in names.items() if old == wanted)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says that label 1 is not too unlikely."""
    model = fitted(docs.select("doc_id", "text"), Tables(spark, sf_dir))
    return docs.where(score(docs, model, "text") >= THRESHOLD)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: of the smallest id, null last.

    Documents of one id are told apart by a hash of their text, and of those alike in
    both any one stays. Whatever a chain of near copies links is one group.
    """
    bounded_batches(spark)
    digest = F.xxhash64("text")
    rows = docs.select("doc_id", digest.alias("digest"), sketch(F.col("text"), SHINGLE, PRINT_WORDS).alias("s"))
    rows = stored(rows.select("doc_id", "digest", "s.*"), "prints")
    roots = proved_roots(rows, docs.select("doc_id", digest.alias("digest"), "text"), SHINGLE, PRINT_BITS)
    grouped = rows.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    chosen = (
        grouped.groupBy("root")
        .agg(F.min(first).alias("first"))
        .select("first.doc_id", "first.digest")
    )
    # How many rows each of these has; more than one only if rows are alike.
    counted = rows.groupBy("doc_id", "digest").count()
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("mark") == F.col("digest"))
    chosen = durable(chosen.toDF("id", "mark").join(counted, same).select("id", "mark", "count"))
    numbered, names = _numbered(docs)
    doc_id, text = _of(names, "doc_id"), _of(names, "text")
    marked = numbered.withColumn("digest", F.xxhash64(text))
    same = F.col("id").eqNullSafe(F.col(doc_id)) & (F.col("mark") == F.col("digest"))
    kept = marked.join(chosen, same)
    if not chosen.where("count > 1").isEmpty():
        several = kept.where("count > 1").dropDuplicates([doc_id, "digest"])
        kept = kept.where("count = 1").unionByName(several)
    return kept.select(*[F.col(c).alias(n) for c, n in names.items()])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that earlier ones have said.

    Bytes of a character that is cut go too. ``n_chars`` becomes the new length. A
    document of which nothing remains goes, unless it was empty before.
    """
    numbered, names = _numbered(docs)
    text = _of(names, "text")
    found = remove_repeats(numbered, _of(names, "doc_id"), text, "repeats")
    kept = found.where("repeats.n_bytes = 0 OR repeats.n_bytes > repeats.n_removed")
    left = readable(F.col("repeats.kept"))
    columns = {c: F.col(c) for c in names} | {text: left}
    out = kept.select(*[columns[c].alias(c) for c in names])
    return _measured(out, names)


def _measured(numbered: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns by their names again, ``n_chars`` as long as the text now is."""
    length = F.length(_of(names, "text")).cast("long")
    out = {new: F.col(new) for new in names}
    if "n_chars" in names.values():
        out[_of(names, "n_chars")] = length
    return numbered.select(*[out[new].alias(old) for new, old in names.items()])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a mix of the sources takes, in as many rows as it takes them.

    A document of w words of which the mix takes t has t div w whole rows, and one with
    the first t mod w words. Documents without words are in no source's budget and go.
    """
    numbered, names = _numbered(docs)
    doc_id, text, source = (_of(names, n) for n in ("doc_id", "text", "source"))
    sized = numbered.withColumns(
        {"size": words(F.col(text)), "key": random_key(F.col(doc_id), F.col(text))}
    )
    taken = mix(sized, source, "size", "key").where("taken > 0")
    full = F.floor(F.col("taken") / F.col("size")).cast("int")
    left = F.col("taken") % F.col("size")
    rows = F.concat(F.array_repeat(F.lit(0).cast("long"), full), F.filter(F.array(left), lambda n: n > 0))
    repeated = taken.withColumn("words", F.explode(rows))
    # The words of a text and what stands between, up to the last word that is taken.
    parts = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    first = F.array_join(F.slice(parts, 1, F.col("words").cast("int")), "")
    cut = repeated.withColumn(text, F.when(F.col("words") == 0, F.col(text)).otherwise(first))
    return _measured(cut.select(*names), names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, how many there are, and whether they decode.

    The new columns are ``ids``, ``n_tokens`` and ``decodes``, with underscores in
    front where a column has that name.
    """
    bounded_batches(spark)
    by = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    ids, count, same = (free_name(docs.columns, n) for n in ("ids", "n_tokens", "decodes"))
    both = free_name(docs.columns, "encoded")
    encoded = docs.withColumn(both, encode_proved(F.col("text"), *by))
    found = encoded.withColumns(
        {ids: F.col(both)["ids"], count: F.size(F.col(both)["ids"]).cast("long"), same: F.col(both)["same"]}
    )
    return found.drop(both)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeats),
    ("source_mixing", mixed),
    ("byte_bpe", tokens),
]

# The stages learn, hash and encode in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = Tables(spark, sf_dir).read("documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
