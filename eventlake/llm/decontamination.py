"""Benchmark decontamination by templates.

Words are made canonical: numbers, names and units become typed placeholders. Windows of five words are hashed
in two forms, canonical and in plain lower case, so that a copy whose case was changed is found too, and joined
with the benchmark's; a window is found if either form is. Where a document holds most of an item's windows along one
alignment, the values that fill the placeholders are compared. They must be renamed consistently (names and units
one-to-one, numbers by a function), as a re-parameterised question does; windows that hold a pair against the
renaming don't count unless their words are equal, so the same template with muddled values is no copy.

DataFrame functions only. The benchmark's windows are broadcast if a count shows them to be few; else both
sides are shuffled by the window's hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BLANKS, fresh, table, written

#: Words of units, lower-case.
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds lb lbs ml l liter liters litre litres "
         "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degrees").split()  # fmt: skip
#: Words of a text whose windows are cut from one row.
_PIECE = 256
SLOTS = ("<n>", "<name>", "<unit>")
_NUMBER = r"^[+-]?[$€£]?\d[\d.,:/]*%?$"
_NAME = r"^\p{Lu}\p{Ll}+$"
_PUNCTUATION = "\"'`´’‘“”«»()[]{}<>.,;:!?…*_~#|/\\=&"


def words_of(text: Column) -> Column:
    """The words, without punctuation around them; words of punctuation only are left out."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: F.trim(w, F.lit(_PUNCTUATION)))
    return F.filter(bare, lambda w: w != "")


def _typed(word: Column, slot, other: Column) -> Column:
    """slot(kind) for a number, name or unit, else `other`."""
    return F.when(word.rlike(_NUMBER), slot("<n>")).when(word.rlike(_NAME), slot("<name>")).when(F.lower(word).isin(UNITS), slot("<unit>")).otherwise(other)


def canonical(word: Column) -> Column:
    """<n>, <name> or <unit> for such a word, else the word in lower case."""
    return _typed(word, F.lit, F.lower(word))


def _is_slot(canon: Column) -> Column:
    return canon.isin(*SLOTS)


def _windows(df: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """key, words, at, pos and hash: for each window of as many words as `sizes` lists a row for its template and, where that has placeholders, one for its words in lower case.

    A template of placeholders only has no row. Words are coded once each. Windows become rows whose hashes are
    compiled expressions on pieces of the codes, cut with an overlap, so no row holds more than a piece of a long
    text: `words` is the window's piece, and pos its place in the text, of which `at` stand before the piece. The
    outer explodes keep Spark from coding all words a second time for a filter on the arrays' sizes.
    """
    code = lambda w: F.xxhash64(F.lower(w)).bitwiseAND(F.lit(2**63 - 1))
    slot = lambda kind: F.lit(-1 - SLOTS.index(kind)).cast("long")
    split = df.select(key, words_of(F.col("text")).alias("words"))
    split = split.select(key, "words", F.transform("words", lambda w: _typed(w, slot, code(w))).alias("canon"), F.transform("words", code).alias("plain"))
    cut = lambda i: F.struct(i.alias("at"), *[F.slice(c, i + 1, _PIECE + max(sizes) - 1).alias(c) for c in ("words", "canon", "plain")])
    pieces = split.select(key, F.inline_outer(F.transform(F.when(F.size("plain") > 0, F.sequence(F.lit(0), F.size("plain") - 1, F.lit(_PIECE))), cut)))
    rows = pieces.select(key, "at", "words", "canon", "plain", F.posexplode_outer("plain").alias("in", "first")).where(F.col("in") < _PIECE)
    out = []
    for size in sizes:
        of = lambda a, size=size: [F.get(F.col(a), F.col("in") + k) for k in range(size)]
        whole = F.col("in") <= F.size("words") - size
        out.append(F.when(whole & (F.greatest(F.lit(-9), *of("canon")) >= 0), F.xxhash64(*of("canon"))))
        out.append(F.when(whole & (F.least(F.lit(9), *of("canon")) < 0), F.xxhash64(*of("plain"))))
    return rows.select(key, "words", "at", (F.col("at") + F.col("in")).alias("pos"), F.explode(F.array(*out)).alias("hash")).where("hash is not null")


def _consistent(found: DataFrame) -> DataFrame:
    """The windows (rows of `found`) with equal words, and those whose values fit the renaming of their alignment.

    The renaming takes each value of an item to the one it most often becomes; names and units must also be the ones that most
    often become it. Of equally frequent pairs the one that comes first in the item stands. Case doesn't matter.
    """
    line = ["doc_id", "item_id", "shift"]
    low = lambda c: F.transform(c, F.lower)
    kinds = F.transform("theirs", canonical)
    places = F.sequence(F.lit(0), F.size("theirs") - 1)
    each = F.arrays_zip(F.transform(places, lambda k: k + F.col("ipos")).alias("at"), kinds.alias("kind"), low("theirs").alias("own"), low("ours").alias("new"))
    loose = found.withColumn("same", low(F.col("theirs")) == low(F.col("ours")))
    pairs = loose.select(*line, "ipos", "same", F.inline(F.filter(each, lambda p: _is_slot(p.kind))))
    often = pairs.groupBy(*line, "kind", "own", "new").agg(F.countDistinct("at").alias("n"), F.min("at").alias("first"))
    first = lambda c: F.row_number().over(Window.partitionBy(*line, "kind", c).orderBy(F.desc("n"), "first", "own", "new"))
    ranked = often.withColumn("by_own", first("own")).withColumn("by_new", first("new"))
    odd = ranked.where("by_own > 1 or (kind != '<n>' and by_new > 1)").select(*line, "kind", "own", "new")
    broken = pairs.where("not same").join(odd, [*line, "kind", "own", "new"], "left_semi").select(*line, "ipos").distinct()
    return loose.where("same").drop("same").unionByName(loose.where("not same").drop("same").join(broken, [*line, "ipos"], "left_anti"))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8, most_broadcast: int = 500_000) -> DataFrame:
    """doc_id, item_id, n_windows, n_found, coverage: documents that hold an item of the benchmark, and which.

    A document holds an item if along consistent alignments it has at least `share` of the item's windows
    of `size` words, as templates or word by word whatever their case. An item with fewer words than a window is
    one window; null texts and texts without words of either side hold nothing. Windows of placeholders only
    don't count, unless an item has no others: then they are matched word by word. Rows with a null doc_id or
    item_id are left out; repeated rows count once. Texts are read whole. Empty tables give an empty result; other columns don't matter.
    """
    items = benchmark.where("item_id is not null").select("item_id", "text").distinct()
    n_words = F.size(words_of(F.col("text")))
    shorter = sorted(r[0] for r in items.select(n_words.alias("n")).where((F.col("n") > 0) & (F.col("n") < size)).distinct().collect())
    window = lambda n: F.slice("words", F.col("pos") - F.col("at") + 1, n)
    cut = lambda of, n: _windows(of, "item_id", [n]).select("item_id", F.col("pos").alias("ipos"), "hash", window(n).alias("theirs"))
    wanted = reduce(DataFrame.unionByName, [cut(items, size), *(cut(items.where(n_words == n), n) for n in shorter)])
    wanted = wanted.withColumn("typed", ~F.forall("theirs", lambda w: _is_slot(canonical(w)))).withColumn("any", F.max("typed").over(Window.partitionBy("item_id")))
    wanted = wanted.where(F.col("typed") | ~F.col("any")).drop("typed", "any")
    wanted = written(spark, wanted.withColumn("n_windows", F.size(F.collect_set("ipos").over(Window.partitionBy("item_id")))), "benchmark")
    n_wanted = wanted.count()
    side = F.broadcast(wanted) if n_wanted <= most_broadcast else wanted
    held = _windows(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id", [size, *shorter])
    # the words of a window are cut out after the join, so they are copied for matches only
    found = held.join(side, "hash").select("doc_id", "item_id", "n_windows", "ipos", (F.col("pos") - F.col("ipos")).alias("shift"), window(F.size("theirs")).alias("ours"), "theirs")
    # consistency only takes windows away, so what has too few before is done
    enough = F.size(F.collect_set("ipos").over(Window.partitionBy("doc_id", "item_id"))) / F.col("n_windows") >= share
    found = written(spark, found.distinct().withColumn("enough", enough).where("enough").drop("enough"), "found")
    same = lambda form: F.transform("ours", form) == F.transform("theirs", form)
    found = found.where(same(canonical) | same(F.lower))  # a hash alone proves nothing
    got = _consistent(found).groupBy("doc_id", "item_id", "n_windows").agg(F.countDistinct("ipos").alias("n_found"))
    out = got.withColumn("coverage", F.col("n_found") / F.col("n_windows")).where(F.col("coverage") >= share)
    return out.select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.col("n_found").cast("long").alias("n_found"), "coverage")


def clean_rows(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, with all columns, that hold no benchmark item; rows without a doc_id stay. Of rows that share one, all go if one does."""
    at = fresh(docs, "gone_id")
    gone = contaminated(spark, docs, benchmark, **how).select(F.col("doc_id").alias(at)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(at), "left_anti")


def _sql_typed(word: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"CASE WHEN regexp_matches({word}, '{_NUMBER}') THEN '<n>' WHEN regexp_matches({word}, '{_NAME}') THEN '<name>' WHEN lower({word}) IN ({units}) THEN '<unit>' ELSE lower({word}) END"


#: The same rules on the words themselves, without hashes.
ORACLE_SQL = f"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
split AS (
  SELECT DISTINCT side, id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: trim(w, '{_PUNCTUATION.replace("'", "''")}')), lambda w: w <> '') AS words
  FROM texts
),
coded AS (SELECT *, list_transform(words, lambda w: lower(w)) AS plain, list_transform(words, lambda w: {_sql_typed("w")}) AS canon FROM split),
sizes AS (SELECT 5 AS n UNION SELECT len(words) FROM split WHERE side = 'i' AND len(words) BETWEEN 1 AND 4),
windows AS (
  SELECT side, id, len(words) AS n_words, n, CAST(p AS BIGINT) AS pos, canon[p + 1:p + n] AS canon, plain[p + 1:p + n] AS plain
  FROM coded, sizes, unnest(range(0, len(words) - n + 1)) AS t(p)
),
typed AS (
  SELECT id AS item_id, pos AS ipos, canon, plain, len(list_filter(canon, lambda c: c NOT IN ('<n>', '<name>', '<unit>'))) > 0 AS typed
  FROM windows WHERE side = 'i' AND n = CASE WHEN n_words < 5 THEN n_words ELSE 5 END
),
wanted AS (
  SELECT *, count(DISTINCT ipos) OVER (PARTITION BY item_id) AS n_windows
  FROM (SELECT *, bool_or(typed) OVER (PARTITION BY item_id) AS has_typed FROM typed) WHERE typed OR NOT has_typed
),
held AS (SELECT id AS doc_id, pos, canon, plain FROM windows WHERE side = 'd'),
found AS (
  SELECT doc_id, item_id, n_windows, ipos, pos - ipos AS shift, h.plain AS ours, w.plain AS theirs, w.canon AS kinds FROM held h JOIN wanted w ON h.canon = w.canon WHERE w.typed
  UNION
  SELECT doc_id, item_id, n_windows, ipos, pos - ipos, h.plain, w.plain, w.canon FROM held h JOIN wanted w ON h.plain = w.plain
),
pairs AS (
  SELECT doc_id, item_id, shift, ipos, ours = theirs AS same, ipos + k - 1 AS place, kinds[k] AS kind, theirs[k] AS own, ours[k] AS new
  FROM found, unnest(range(1, len(theirs) + 1)) AS t(k) WHERE kinds[k] IN ('<n>', '<name>', '<unit>')
),
often AS (SELECT doc_id, item_id, shift, kind, own, new, count(DISTINCT place) AS n, min(place) AS first_at FROM pairs GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift, kind, own ORDER BY n DESC, first_at, new) AS by_own,
         row_number() OVER (PARTITION BY doc_id, item_id, shift, kind, new ORDER BY n DESC, first_at, own) AS by_new
  FROM often
),
odd AS (SELECT doc_id, item_id, shift, kind, own, new FROM ranked WHERE by_own > 1 OR (kind <> '<n>' AND by_new > 1)),
broken AS (SELECT DISTINCT doc_id, item_id, shift, ipos FROM pairs SEMI JOIN odd USING (doc_id, item_id, shift, kind, own, new) WHERE NOT same),
counted AS (
  SELECT doc_id, item_id, n_windows, count(DISTINCT ipos) AS n_found
  FROM (SELECT * FROM found WHERE ours = theirs UNION ALL SELECT * FROM found ANTI JOIN broken USING (doc_id, item_id, shift, ipos) WHERE ours <> theirs) GROUP BY ALL
)
SELECT doc_id, item_id, n_windows, n_found, n_found / n_windows AS coverage FROM counted WHERE n_found / n_windows >= 0.8
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
