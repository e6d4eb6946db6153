"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.catalog import fixtures as fx
from gleanset.catalog import oracles as sq
from gleanset.functions import chat
from gleanset.functions import labels as lb
from gleanset.functions import text as tx
from gleanset.functions.keys import text_key
from gleanset.operators import combine, dedup, generation, metrics, profile, sampling
from gleanset.operators import ranking as rk
from gleanset.operators.observed import Dropped, StageCounts, all_stages
from gleanset.plans import datasets, evaluation, synthetic
from gleanset.session import materialized, scratch_path
from gleanset.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EN_QUOTA = (50, 300)
VI_QUOTA = (12, 60)
VI_SHORT_QUOTA = (12, 200)


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")


# --- cleaning and mapping -------------------------------------------------------------------


@query(
    "en_clean_counts",
    f"""WITH {sq.EN_CLEAN}
    SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM en GROUP BY label""",
)
def _(spark, sf):
    rows = datasets.english_rows(fx.en_raw(spark, sf))
    shares = profile.value_shares(rows, ["label"])
    return six(shares, "share").select(F.col("value").alias("label"), "n", "share")


@query("english_clean_rows", f"WITH {sq.EN_CLEAN} SELECT id, input, label FROM en")
def _(spark, sf):
    return datasets.english_clean(fx.en_raw(spark, sf), folder=scratch_path(spark, "surplus"))


@query(
    "clean_text",
    f"""SELECT id, cleaned, length(cleaned) AS chars, {sq.words('cleaned')} AS words,
      regexp_matches(cleaned, '[a-zA-Z]') AS has_letter, {sq.words('cleaned')} >= 3 AS long_enough
    FROM (SELECT doc_id AS id, {sq.clean('text')} AS cleaned FROM documents)""",
)
def _(spark, sf):
    cleaned = F.col("cleaned")
    return documents(spark, sf).select("id", tx.clean_text(F.col("text")).alias("cleaned")).select(
        "id",
        "cleaned",
        tx.char_length(cleaned).alias("chars"),
        tx.word_count(cleaned).alias("words"),
        tx.has_ascii_letter(cleaned).alias("has_letter"),
        tx.has_min_words(cleaned, fixed.EN_MIN_WORDS).alias("long_enough"),
    )


@query(
    "label_mapping",
    f"""WITH {sq.EN_RAW}, {sq.VI_RAW}
    SELECT id, 'EN' AS language, {sq.map_terms('output')} AS label, CAST(NULL AS VARCHAR) AS topic FROM en_raw
    UNION ALL
    SELECT id, 'VI', {sq.map_codes('sentiment')}, {sq.map_codes('topic', fixed.TOPIC_CODES)} FROM vi_raw""",
)
def _(spark, sf):
    en = fx.en_raw(spark, sf).select(
        "id", lb.map_terms(F.col("output")).alias("label"), F.lit(None).cast("string").alias("topic")
    )
    vi = fx.vi_raw(spark, sf).select(
        "id", lb.map_codes(F.col("sentiment")).alias("label"), lb.map_topics(F.col("topic")).alias("topic")
    )
    return combine.tagged_union({"EN": en, "VI": vi}, "language")


# --- duplicates -----------------------------------------------------------------------------


@query(
    "dedup_keep_first",
    f"""WITH {sq.EN_RAW} SELECT id, input, output FROM en_raw
    QUALIFY row_number() OVER (PARTITION BY input ORDER BY id) = 1""",
)
def _(spark, sf):
    return dedup.dedup_keep_first(fx.en_raw(spark, sf), ["input"], folder=scratch_path(spark, "surplus"))


@query(
    "dedup_drop_all",
    f"""WITH {sq.VI_RAW} SELECT id, sentence, sentiment FROM vi_raw
    QUALIFY count(*) OVER (PARTITION BY sentence) = 1""",
)
def _(spark, sf):
    rows = fx.vi_raw(spark, sf).select("id", "sentence", "sentiment")
    return dedup.dedup_drop_all(rows, ["sentence"], folder=scratch_path(spark, "surplus"))


@query(
    "duplicates_listing",
    f"""WITH {sq.EN_RAW} SELECT input, id, output FROM en_raw
    QUALIFY count(*) OVER (PARTITION BY input) > 1 ORDER BY input, id""",
)
def _(spark, sf):
    rows = dedup.duplicate_rows(fx.en_raw(spark, sf), ["input"], folder=scratch_path(spark, "surplus"))
    return rows.select("input", "id", "output").orderBy("input", "id")


@query(
    "drop_listed",
    f"""WITH {sq.EN_RAW} SELECT id, input FROM en_raw WHERE input NOT IN
    (SELECT text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)""",
)
def _(spark, sf):
    toxic = fx.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    listed = fx.table(spark, sf, "documents").join(toxic, "doc_id").select("text")
    return dedup.drop_listed(fx.en_raw(spark, sf).select("id", "input"), "input", listed, scratch_path(spark, "listed"))


@query(
    "drop_listed_counts",
    f"""WITH {sq.EN_RAW}, t AS (SELECT text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)
    SELECT count(*) FILTER (input IN (SELECT text FROM t)) AS removed,
      count(*) FILTER (input NOT IN (SELECT text FROM t)) AS kept FROM en_raw""",
)
def _(spark, sf):
    """What a listed table drops, counted by the run that writes what it keeps."""
    toxic = fx.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    listed = fx.table(spark, sf, "documents").join(toxic, "doc_id").select("text")
    rows, dropped = fx.en_raw(spark, sf).select("id", "input"), Dropped()
    kept = dedup.drop_listed(rows, "input", listed, scratch_path(spark, "listed"), dropped)
    materialized(kept, scratch_path(spark, "kept"))
    return dropped.table(spark)


@query(
    "drop_conflicting",
    f"""WITH {sq.EN_RAW}, m AS (SELECT *, coalesce({sq.map_terms('output')}, 'none') AS label FROM en_raw)
    SELECT id, input, output FROM m
    WINDOW w AS (PARTITION BY input) QUALIFY min(label) OVER w = max(label) OVER w""",
)
def _(spark, sf):
    index = F.coalesce(lb.class_index(lb.map_terms(F.col("output"))), F.lit(-1))
    rows = fx.en_raw(spark, sf).withColumn("class", index)
    return dedup.drop_conflicting(rows, ["input"], "class", folder=scratch_path(spark, "conflicts")).drop("class")


@query(
    "drop_conflicting_by_topic",
    f"""WITH {sq.VI_RAW} SELECT id, sentence, sentiment, topic FROM vi_raw
    WINDOW w AS (PARTITION BY sentence, topic) QUALIFY min(sentiment) OVER w = max(sentiment) OVER w""",
)
def _(spark, sf):
    rows = fx.vi_raw(spark, sf).drop("split")
    return dedup.drop_conflicting(
        rows, ["sentence"], "sentiment", within=["topic"], folder=scratch_path(spark, "conflicts")
    )


@query(
    "duplicate_counts",
    f"""WITH {sq.EN_RAW},
    d AS (SELECT 'input' AS "column", count(*) AS rows, count(DISTINCT input) AS distinct_rows FROM en_raw
      UNION ALL SELECT 'output', count(*), count(DISTINCT output) FROM en_raw
      UNION ALL SELECT '*', count(*), count(DISTINCT (input, output)) FROM en_raw)
    SELECT *, rows - distinct_rows AS duplicates FROM d""",
)
def _(spark, sf):
    return dedup.duplicate_counts(fx.en_raw(spark, sf), ["input", "output"])


@query("distinct_sorted", "SELECT DISTINCT text FROM documents ORDER BY text")
def _(spark, sf):
    return dedup.distinct_sorted(documents(spark, sf), "text", folder=scratch_path(spark, "surplus"))


@query(
    "duplicate_counts_by_split",
    f"""WITH {sq.VI_RAW},
    d AS (SELECT split, 'sentence' AS "column", count(*) AS rows, count(DISTINCT sentence) AS distinct_rows FROM vi_raw GROUP BY 1
      UNION ALL SELECT split, 'topic', count(*), count(DISTINCT topic) FROM vi_raw GROUP BY 1
      UNION ALL SELECT split, '*', count(*), count(DISTINCT (sentence, topic)) FROM vi_raw GROUP BY 1)
    SELECT *, rows - distinct_rows AS duplicates FROM d""",
)
def _(spark, sf):
    return dedup.duplicate_counts(fx.vi_raw(spark, sf), ["sentence", "topic"], ["split"])


# --- profiles -------------------------------------------------------------------------------

FREQ = f"""lengths AS (SELECT lang, 'char' AS measure, length(text) AS length FROM documents
  UNION ALL SELECT lang, 'word', {sq.words('text')} FROM documents)"""


@query(
    "null_profile",
    """WITH t AS (SELECT d.lang, d.doc_id, d.text, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT lang, 'doc_id' AS "column", 'bigint' AS type, count(*) AS rows, count(doc_id) AS non_null,
      count(*) - count(doc_id) AS nulls FROM t GROUP BY lang
    UNION ALL SELECT lang, 'text', 'string', count(*), count(text), count(*) - count(text) FROM t GROUP BY lang
    UNION ALL SELECT lang, 'quality', 'int', count(*), count(quality), count(*) - count(quality) FROM t GROUP BY lang""",
)
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "text")
    joined = docs.join(fx.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return profile.table_profile(joined, by=["lang"])


@query("first_rows", "SELECT doc_id AS id, lang, text FROM documents ORDER BY doc_id LIMIT 5")
def _(spark, sf):
    return profile.first_rows(documents(spark, sf).select("id", "lang", "text"))


@query(
    "length_describe",
    f"""WITH {FREQ} SELECT lang, measure, count(*) AS count, round(avg(length), 6) AS mean,
      round(stddev_samp(length), 6) AS std, min(length) AS min, round(quantile_cont(length, 0.25), 6) AS q25,
      round(quantile_cont(length, 0.5), 6) AS q50, round(quantile_cont(length, 0.75), 6) AS q75, max(length) AS max
    FROM lengths GROUP BY lang, measure""",
)
def _(spark, sf):
    freq = profile.length_frequencies(documents(spark, sf), "text", ["lang"])
    return six(profile.describe_lengths(freq, ["lang"]), "mean", "std", "q25", "q50", "q75")


@query(
    "length_histogram",
    f"""WITH {FREQ}, edges AS (SELECT lang, measure, min(length) AS lo, max(length) AS hi FROM lengths GROUP BY 1, 2),
    binned AS (SELECT lang, measure, CASE WHEN lo = hi THEN 25 ELSE least((length - lo) * 50 // (hi - lo), 49) END AS bin
      FROM lengths JOIN edges USING (lang, measure)),
    cells AS (SELECT lang, measure, lo, hi, unnest(range(50)) AS bin FROM edges),
    flat AS (SELECT *, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS a,
      CASE WHEN lo = hi THEN 1.0 ELSE hi - lo END / 50 AS w FROM cells)
    SELECT f.lang, f.measure, f.bin, round(CAST(a + f.bin * w AS DOUBLE), 6) AS lower,
      round(CAST(a + (f.bin + 1) * w AS DOUBLE), 6) AS upper, count(b.bin) AS n
    FROM flat f LEFT JOIN binned b ON f.lang = b.lang AND f.measure = b.measure AND f.bin = b.bin
    GROUP BY ALL""",
)
def _(spark, sf):
    freq = profile.length_frequencies(documents(spark, sf), "text", ["lang"])
    return six(profile.length_histogram(freq, ["lang"]), "lower", "upper")


# The middle of all lengths that share their eight leading bits.
SKETCHED = f"""{FREQ}, wide AS (SELECT *, CAST(1 AS BIGINT) << greatest(length(bin(length)) - 8, 0) AS w FROM lengths),
  sketched AS (SELECT lang, measure, length - length % w + (w - 1) // 2 AS length FROM wide)"""


@query(
    "length_sketch",
    f"""WITH {SKETCHED} SELECT lang, measure, count(*) AS count, round(avg(length), 6) AS mean,
      round(stddev_samp(length), 6) AS std, CAST(min(length) AS BIGINT) AS min, round(quantile_cont(length, 0.25), 6) AS q25,
      round(quantile_cont(length, 0.5), 6) AS q50, round(quantile_cont(length, 0.75), 6) AS q75,
      CAST(max(length) AS BIGINT) AS max
    FROM sketched GROUP BY lang, measure""",
)
def _(spark, sf):
    """Sketches of each language and source, written, then merged over the sources."""
    sketch = profile.length_sketch(documents(spark, sf), "text", ["lang", "source"])
    parts = materialized(sketch, scratch_path(spark, "sketches"))
    merged = profile.merge_sketches([parts], ["lang"])
    return six(profile.describe_lengths(merged, ["lang"]), "mean", "std", "q25", "q50", "q75")


@query(
    "boxplot_stats",
    f"""WITH {FREQ}, q AS (SELECT lang, measure, quantile_cont(length, 0.25) AS a, quantile_cont(length, 0.5) AS b,
      quantile_cont(length, 0.75) AS c FROM lengths GROUP BY 1, 2),
    j AS (SELECT *, length BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) AS inside
      FROM lengths JOIN q USING (lang, measure))
    SELECT lang, measure, round(max(a), 6) AS q25, round(max(b), 6) AS q50, round(max(c), 6) AS q75,
      min(length) FILTER (inside) AS whisker_low, max(length) FILTER (inside) AS whisker_high,
      count(*) FILTER (NOT inside) AS outliers
    FROM j GROUP BY lang, measure""",
)
def _(spark, sf):
    freq = profile.length_frequencies(documents(spark, sf), "text", ["lang"])
    return six(profile.box_figures(freq, ["lang"]), "q25", "q50", "q75")


@query(
    "value_shares",
    f"""WITH {sq.VI_RAW}, v AS (
      SELECT split, 'sentiment' AS "column", {sq.map_codes('sentiment')} AS value FROM vi_raw
      UNION ALL SELECT split, 'topic', {sq.map_codes('topic', fixed.TOPIC_CODES)} FROM vi_raw)
    SELECT split, "column", value, count(*) AS n,
      round(count(*) / sum(count(*)) OVER (PARTITION BY split, "column"), 6) AS share,
      round(100 * count(*) / sum(count(*)) OVER (PARTITION BY split, "column"), 6) AS percent
    FROM v GROUP BY split, "column", value""",
)
def _(spark, sf):
    named = fx.vi_raw(spark, sf).select(
        "split", lb.map_codes(F.col("sentiment")).alias("sentiment"), lb.map_topics(F.col("topic")).alias("topic")
    )
    shares = profile.value_shares(named, ["sentiment", "topic"], ["split"], scratch_path(spark, "shares"))
    return six(shares, "share", "percent")


@query(
    "distinct_values",
    f"""WITH {sq.VI_RAW} SELECT DISTINCT split, 'sentiment' AS "column", CAST(sentiment AS VARCHAR) AS value FROM vi_raw
    UNION ALL SELECT DISTINCT split, 'topic', CAST(topic AS VARCHAR) FROM vi_raw""",
)
def _(spark, sf):
    return profile.distinct_values(fx.vi_raw(spark, sf), ["sentiment", "topic"], ["split"])


@query(
    "top_words",
    r"""SELECT word, count(*) AS n FROM
      (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents)
    GROUP BY word ORDER BY n DESC, word LIMIT 20""",
)
def _(spark, sf):
    return profile.top_words(documents(spark, sf), "text", 20)


@query(
    "eda_findings",
    f"""WITH {sq.EN_RAW}, f AS (SELECT * FROM en_raw QUALIFY row_number() OVER (PARTITION BY input ORDER BY id) = 1),
    s AS (SELECT min(c) / sum(c) AS share FROM (SELECT count(*) AS c FROM f GROUP BY output)),
    w AS (SELECT max({sq.words('input')}) AS hi, min({sq.words('input')}) AS lo,
      count(*) - count(DISTINCT input) AS surplus FROM f)
    SELECT 'class_share' AS finding, round(share, 6) AS value, share < 0.1 AS flagged FROM s
    UNION ALL SELECT 'longest_words', hi, hi > 500 FROM w UNION ALL SELECT 'shortest_words', lo, lo < 5 FROM w
    UNION ALL SELECT 'duplicate_texts', surplus, surplus > 0 FROM w""",
)
def _(spark, sf):
    narrow = fx.en_raw(spark, sf).select(
        "id", "output", text_key(F.col("input")).alias("key"), tx.word_count(F.col("input")).alias("words")
    )
    return six(profile.findings(dedup.dedup_keep_first(narrow, ["key"]), "output", "words", "key"), "value")


@query(
    "findings_by_split",
    f"""WITH {sq.VI_RAW},
    s AS (SELECT split, min(c) / sum(c) AS share FROM (SELECT split, count(*) AS c FROM vi_raw GROUP BY split, sentiment) GROUP BY 1),
    t AS (SELECT split, min(c) / sum(c) AS share FROM (SELECT split, count(*) AS c FROM vi_raw GROUP BY split, topic) GROUP BY 1),
    w AS (SELECT split, max({sq.words('sentence')}) AS hi, min({sq.words('sentence')}) AS lo,
      count(*) - count(DISTINCT sentence) AS surplus FROM vi_raw GROUP BY 1)
    SELECT split, 'class_share_sentiment' AS finding, round(share, 6) AS value, share < 0.1 AS flagged FROM s
    UNION ALL SELECT split, 'class_share_topic', round(share, 6), share < 0.1 FROM t
    UNION ALL SELECT split, 'longest_words', hi, hi > 500 FROM w UNION ALL SELECT split, 'shortest_words', lo, lo < 5 FROM w
    UNION ALL SELECT split, 'duplicate_texts', surplus, surplus > 0 FROM w""",
)
def _(spark, sf):
    narrow = fx.vi_raw(spark, sf).select(
        "split", "sentiment", "topic", text_key(F.col("sentence")).alias("key"), tx.word_count(F.col("sentence")).alias("words")
    )
    return six(profile.findings(narrow, ["sentiment", "topic"], "words", "key", ["split"]), "value")


@query(
    "first_rows_by_language",
    """SELECT doc_id AS id, lang, text FROM documents
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5""",
)
def _(spark, sf):
    return profile.first_rows(documents(spark, sf).select("id", "lang", "text"), by=["lang"])


@query(
    "stage_funnel",
    f"""WITH {sq.EN_CLEAN} SELECT CAST(0 AS BIGINT) AS step, 'loaded' AS stage, (SELECT count(*) FROM en_raw) AS rows_left
    UNION ALL SELECT 1, 'deduplicated', (SELECT count(*) FROM en_first)
    UNION ALL SELECT 2, 'cleaned', (SELECT count(*) FROM en_long)
    UNION ALL SELECT 3, 'mapped', (SELECT count(*) FROM en)""",
)
def _(spark, sf):
    return datasets.english_funnel(fx.en_raw(spark, sf))


@query(
    "stage_funnel_second",
    f"""WITH {sq.VI_CLEAN} SELECT CAST(0 AS BIGINT) AS step, 'loaded' AS stage, (SELECT count(*) FROM vi_raw) AS rows_left
    UNION ALL SELECT 1, 'unlisted', (SELECT count(*) FROM vi_unlisted)
    UNION ALL SELECT 2, 'deduplicated', (SELECT count(*) FROM vi_first)
    UNION ALL SELECT 3, 'long_enough', (SELECT count(*) FROM vi_long)
    UNION ALL SELECT 4, 'mapped', (SELECT count(*) FROM vi)""",
)
def _(spark, sf):
    return datasets.second_funnel(fx.vi_raw(spark, sf))


@query(
    "dataset_funnel",
    f"""WITH {sq.EN_CLEAN}, {sq.VI_CLEAN}
    SELECT 'EN' AS language, CAST(0 AS BIGINT) AS step, 'loaded' AS stage, (SELECT count(*) FROM en_raw) AS rows_left
    UNION ALL SELECT 'EN', 1, 'deduplicated', (SELECT count(*) FROM en_first)
    UNION ALL SELECT 'EN', 2, 'cleaned', (SELECT count(*) FROM en_long)
    UNION ALL SELECT 'EN', 3, 'mapped', (SELECT count(*) FROM en)
    UNION ALL SELECT 'VI', 0, 'loaded', (SELECT count(*) FROM vi_raw)
    UNION ALL SELECT 'VI', 1, 'unlisted', (SELECT count(*) FROM vi_unlisted)
    UNION ALL SELECT 'VI', 2, 'deduplicated', (SELECT count(*) FROM vi_first)
    UNION ALL SELECT 'VI', 3, 'long_enough', (SELECT count(*) FROM vi_long)
    UNION ALL SELECT 'VI', 4, 'mapped', (SELECT count(*) FROM vi)""",
)
def _(spark, sf):
    """The rows left after each stage of a build, counted by the run that writes the dataset."""
    counts = {"EN": StageCounts(), "VI": StageCounts()}
    built = datasets.build_dataset(fx.en_raw(spark, sf), fx.vi_raw(spark, sf), EN_QUOTA, VI_QUOTA, counts=counts)
    datasets.write_dataset(built, scratch_path(spark, "dataset"))
    return all_stages(counts, spark, "language")


@query(
    "word_length_lookup",
    f"SELECT doc_id AS id, text, {sq.words('text')} AS word_length FROM documents WHERE {sq.words('text')} IN (1, 5, 303)",
)
def _(spark, sf):
    return profile.with_word_length(documents(spark, sf).select("id", "text"), "text", [1, 5, 303])


@query(
    "word_length_counts",
    f"""SELECT CAST(n AS BIGINT) AS word_length, (SELECT count(*) FROM documents WHERE {sq.words('text')} = n) AS n
    FROM (SELECT unnest([1, 303]) AS n)""",
)
def _(spark, sf):
    return profile.word_length_counts(documents(spark, sf), "text", [1, 303])


# --- samples and splits ---------------------------------------------------------------------


@query(
    "sample_per_class",
    f"""WITH {sq.EN_CLEAN} SELECT id, input, label FROM en
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY {sq.draw()}) <= 40""",
)
def _(spark, sf):
    raw = fx.en_raw(spark, sf)
    picked = sampling.sample_per_class(datasets.english_rows(raw), "label", 40)
    texts = raw.select("id", tx.clean_text(F.col("input")).alias("input"))
    return rk.fetch(texts, picked, "id", 40 * len(fixed.LABELS))


@query(
    "sample_per_source",
    f"""SELECT id, source FROM (SELECT doc_id AS id, source FROM documents)
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY {sq.draw()}) <= 7""",
)
def _(spark, sf):
    rows = documents(spark, sf).select("id", "source")
    return sampling.sample_per_class(rows, "source", 7)


@query(
    "remaining_rows",
    f"""SELECT id, lang FROM (SELECT doc_id AS id, lang FROM documents)
    QUALIFY row_number() OVER (ORDER BY {sq.draw()}) > 100""",
)
def _(spark, sf):
    rows = documents(spark, sf).select("id", "lang")
    return sampling.remaining(rows, sampling.random_n(rows, 100), bound=100)


@query(
    "random_n",
    f"SELECT id, text FROM (SELECT doc_id AS id, text FROM documents) ORDER BY {sq.draw()} LIMIT 100",
)
def _(spark, sf):
    return sampling.random_n(documents(spark, sf).select("id", "text"), 100)


@query(
    "top_up",
    f"""WITH {sq.EN_CLEAN}, s AS (SELECT id, label FROM en WHERE label = 'neutral'
      QUALIFY row_number() OVER (ORDER BY {sq.draw()}) <= 30),
    p AS (SELECT id, label, row_number() OVER (ORDER BY {sq.draw()}) AS r FROM en WHERE label <> 'neutral')
    SELECT id, label FROM s UNION ALL SELECT id, label FROM p
    WHERE r <= 100 - (SELECT count(*) FROM s) AND (SELECT count(*) FROM p) >= 100 - (SELECT count(*) FROM s)""",
)
def _(spark, sf):
    # The narrow rows are read by several steps; written once, the texts are scanned once.
    rows = materialized(datasets.english_rows(fx.en_raw(spark, sf)), scratch_path(spark, "rows"))
    sample = sampling.sample_per_class(rows, "label", 30, classes=["neutral"])
    return sampling.top_up(sample.select("id", "label"), rows.filter("label <> 'neutral'"), 100)


@query("balanced_split", f"WITH {sq.EN_CLEAN}, {sq.balanced('en', 's', *EN_QUOTA)} SELECT * FROM s")
def _(spark, sf):
    return sampling.balanced_split(datasets.english_rows(fx.en_raw(spark, sf)), *EN_QUOTA)


@query("scarce_first_split", f"WITH {sq.VI_CLEAN}, {sq.scarce_first('vi', 's', *VI_QUOTA)} SELECT * FROM s")
def _(spark, sf):
    return sampling.scarce_first_split(datasets.second_rows(fx.vi_raw(spark, sf)), *VI_QUOTA)


@query("scarce_first_short", f"WITH {sq.VI_CLEAN}, {sq.scarce_first('vi', 's', *VI_SHORT_QUOTA)} SELECT * FROM s")
def _(spark, sf):
    return sampling.scarce_first_split(datasets.second_rows(fx.vi_raw(spark, sf)), *VI_SHORT_QUOTA)


@query(
    "proportional_sample",
    f"""WITH {sq.EN_CLEAN},
    c AS (SELECT label, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, label) AS o FROM en GROUP BY label),
    q AS (SELECT *, CAST(round_even(c / (SELECT sum(c) FROM c) * 200, 0) AS BIGINT) AS q FROM c),
    d AS (SELECT *, 200 - (SELECT sum(q) FROM q) AS d, row_number() OVER (ORDER BY q, o) AS small FROM q),
    k AS (SELECT label, CASE WHEN (SELECT count(*) FROM en) <= 200 THEN c
      ELSE least(c, CASE WHEN d > 0 AND o = 1 THEN q + d WHEN d < 0 AND small = 1 THEN greatest(q + d, 0) ELSE q END)
      END AS k FROM d),
    r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {sq.draw()}) AS r FROM en),
    taken AS (SELECT id, label FROM r JOIN k USING (label) WHERE r <= k),
    capped AS (SELECT id, label FROM taken QUALIFY row_number() OVER (ORDER BY {sq.draw()}) <= 200),
    more AS (SELECT id, label, row_number() OVER (ORDER BY {sq.draw()}) AS r FROM en WHERE id NOT IN (SELECT id FROM taken))
    SELECT id, label FROM capped UNION ALL SELECT id, label FROM more WHERE r <= 200 - (SELECT count(*) FROM capped)""",
)
def _(spark, sf):
    return sampling.proportional_sample(datasets.english_rows(fx.en_raw(spark, sf)), "label", 200)


@query(
    "shortfall_report",
    f"""WITH {sq.VI_CLEAN}, {sq.scarce_first('vi', 's', *VI_SHORT_QUOTA)},
    goals AS (SELECT split, label, n // 3 AS wanted FROM (VALUES ('eval', 12), ('train', 200)) g(split, n),
      (SELECT unnest(['negative', 'neutral', 'positive']) AS label)),
    whole AS (SELECT * FROM goals UNION ALL SELECT * FROM (VALUES ('eval', '*', 12), ('train', '*', 200))),
    got AS (SELECT split, label, count(*) AS got FROM s GROUP BY 1, 2
      UNION ALL SELECT split, '*', count(*) FROM s GROUP BY 1)
    SELECT split, label, CAST(wanted AS BIGINT) AS wanted, coalesce(got, 0) AS got, greatest(wanted - coalesce(got, 0), 0) AS missing
    FROM whole LEFT JOIN got USING (split, label)""",
)
def _(spark, sf):
    rows = datasets.second_rows(fx.vi_raw(spark, sf))
    splits = sampling.scarce_first_split(rows, *VI_SHORT_QUOTA)
    return sampling.shortfall(splits, {"eval": VI_SHORT_QUOTA[0], "train": VI_SHORT_QUOTA[1]})


EN_SHORT_QUOTA = (60, 2_000_000)


@query(
    "shortfall_english",
    f"""WITH {sq.EN_CLEAN}, {sq.balanced('en', 's', *EN_SHORT_QUOTA)},
    goals AS (SELECT split, label, n // 3 AS wanted FROM (VALUES ('eval', {EN_SHORT_QUOTA[0]}), ('train', {EN_SHORT_QUOTA[1]})) g(split, n),
      (SELECT unnest(['negative', 'neutral', 'positive']) AS label)),
    whole AS (SELECT * FROM goals
      UNION ALL SELECT * FROM (VALUES ('eval', '*', {EN_SHORT_QUOTA[0]}), ('train', '*', {EN_SHORT_QUOTA[1]}))),
    got AS (SELECT split, label, count(*) AS got FROM s GROUP BY 1, 2
      UNION ALL SELECT split, '*', count(*) FROM s GROUP BY 1)
    SELECT split, label, CAST(wanted AS BIGINT) AS wanted, coalesce(got, 0) AS got, greatest(wanted - coalesce(got, 0), 0) AS missing
    FROM whole LEFT JOIN got USING (split, label)""",
)
def _(spark, sf):
    splits = sampling.balanced_split(datasets.english_rows(fx.en_raw(spark, sf)), *EN_SHORT_QUOTA)
    return sampling.shortfall(splits, {"eval": EN_SHORT_QUOTA[0], "train": EN_SHORT_QUOTA[1]})


@query(
    "split_overlap",
    """WITH s AS (SELECT doc_id AS id, text, CASE WHEN doc_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split
      FROM documents),
    v AS (SELECT 'id' AS measure, split, CAST(id AS VARCHAR) AS value FROM s
      UNION ALL SELECT 'text', split, text FROM s),
    g AS (SELECT measure, value, count(*) FILTER (split = 'eval') AS e, count(*) FILTER (split = 'train') AS t
      FROM v GROUP BY 1, 2)
    SELECT measure, count(*) FILTER (e > 0 AND t > 0) AS shared_values,
      CAST(coalesce(sum(e) FILTER (t > 0), 0) AS BIGINT) AS eval_rows_shared,
      CAST(coalesce(sum(t) FILTER (e > 0), 0) AS BIGINT) AS train_rows_shared
    FROM g GROUP BY measure""",
)
def _(spark, sf):
    splits = documents(spark, sf).select(
        "id",
        F.when(F.col("id") % 5 == 0, "eval").otherwise("train").alias("split"),
        text_key(F.col("text")).alias("key"),
    )
    return sampling.split_overlap(splits)


@query("shuffled_rows", f"SELECT id, lang FROM (SELECT doc_id AS id, lang FROM documents) ORDER BY {sq.draw()}")
def _(spark, sf):
    return sampling.shuffled(documents(spark, sf).select("id", "lang"))


# --- whole builds, unions, positions --------------------------------------------------------


@query(
    "dataset_build",
    f"""WITH {sq.EN_CLEAN}, {sq.VI_CLEAN},
    {sq.balanced('en', 'es', *EN_QUOTA)}, {sq.scarce_first('vi', 'vs', *VI_QUOTA)}
    SELECT 'EN' AS language, es.split, id, '{fixed.INSTRUCTION}' AS instruction, en.input, es.label AS output
    FROM es JOIN en USING (id)
    UNION ALL SELECT 'VI', vs.split, id, '{fixed.INSTRUCTION}', vi.input, vs.label FROM vs JOIN vi USING (id)""",
)
def dataset_build(spark, sf):
    return datasets.build_dataset(fx.en_raw(spark, sf), fx.vi_raw(spark, sf), EN_QUOTA, VI_QUOTA)


_BUILT = SQL["dataset_build"].replace("SELECT 'EN' AS language", "built AS (SELECT 'EN' AS language", 1).replace(
    f"{sq.scarce_first('vi', 'vs', *VI_QUOTA)}\n", f"{sq.scarce_first('vi', 'vs', *VI_QUOTA)},\n", 1
) + ")"


@query(
    "dataset_overlap",
    _BUILT
    + """, v AS (SELECT 'id' AS measure, split, concat(language, ':', id) AS value FROM built
      UNION ALL SELECT 'text', split, input FROM built),
    g AS (SELECT measure, value, count(*) FILTER (split = 'eval') AS e, count(*) FILTER (split = 'train') AS t
      FROM v GROUP BY 1, 2)
    SELECT measure, count(*) FILTER (e > 0 AND t > 0) AS shared_values,
      CAST(coalesce(sum(e) FILTER (t > 0), 0) AS BIGINT) AS eval_rows_shared,
      CAST(coalesce(sum(t) FILTER (e > 0), 0) AS BIGINT) AS train_rows_shared
    FROM g GROUP BY measure""",
)
def _(spark, sf):
    return datasets.dataset_overlap(dataset_build(spark, sf))


@query(
    "dataset_shortfall",
    _BUILT
    + f""", goals AS (SELECT language, split, label, n // 3 AS wanted FROM (VALUES ('EN', 'eval', {EN_QUOTA[0]}), ('EN', 'train', {EN_QUOTA[1]}),
        ('VI', 'eval', {VI_QUOTA[0]}), ('VI', 'train', {VI_QUOTA[1]})) g(language, split, n),
      (SELECT unnest(['negative', 'neutral', 'positive']) AS label)),
    whole AS (SELECT * FROM goals UNION ALL SELECT * FROM (VALUES ('EN', 'eval', '*', {EN_QUOTA[0]}), ('EN', 'train', '*', {EN_QUOTA[1]}),
        ('VI', 'eval', '*', {VI_QUOTA[0]}), ('VI', 'train', '*', {VI_QUOTA[1]}))),
    got AS (SELECT language, split, output AS label, count(*) AS got FROM built GROUP BY 1, 2, 3
      UNION ALL SELECT language, split, '*', count(*) FROM built GROUP BY 1, 2)
    SELECT language, split, label, CAST(wanted AS BIGINT) AS wanted, coalesce(got, 0) AS got,
      greatest(wanted - coalesce(got, 0), 0) AS missing
    FROM whole LEFT JOIN got USING (language, split, label)""",
)
def _(spark, sf):
    wanted = {"EN": dict(zip(("eval", "train"), EN_QUOTA)), "VI": dict(zip(("eval", "train"), VI_QUOTA))}
    return datasets.dataset_shortfall(dataset_build(spark, sf), wanted)


@query(
    "train_union_synthetic",
    f"""WITH {sq.EN_CLEAN}, {sq.ANSWERED}
    SELECT 'original' AS source, '{fixed.INSTRUCTION}' AS instruction, input, label AS output FROM en
    UNION ALL SELECT 'synthetic', instruction, input_text, ground_truth FROM answers""",
)
def _(spark, sf):
    train = combine.to_instructions(datasets.english_clean(fx.en_raw(spark, sf), folder=scratch_path(spark, "surplus")), "input", "label")
    made = fx.answers(spark, sf).select(
        "instruction", F.col("input_text").alias("input"), F.col("ground_truth").alias("output")
    )
    return datasets.add_synthetic(train, made)


@query(
    "eval_position_language",
    """SELECT id, lang, p AS position, CASE WHEN p < n / 2 THEN 'EN' ELSE 'VI' END AS language
    FROM (SELECT doc_id AS id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n
      FROM documents)""",
)
def _(spark, sf):
    return combine.position_language(documents(spark, sf).select("id", "lang"))


# --- chat records ---------------------------------------------------------------------------

_HEAD = "<|start_header_id|>"
_MID = "<|end_header_id|>\n\n"
_END = "<|eot_id|>"
_SYSTEM = fixed.SYSTEM_PROMPT.replace("'", "''")


def _sql_chat(text: str, answer: str | None) -> str:
    user = sq.strip(f"concat('{fixed.INSTRUCTION}', chr(10), chr(10), 'Text: ', {text})")
    opened = f", '{_HEAD}assistant{_MID}'" if answer is None else ""
    reply = f", '{_HEAD}assistant{_MID}', {sq.strip(answer)}, '{_END}'" if answer is not None else ""
    return (
        f"concat('<|begin_of_text|>{_HEAD}system{_MID}{_SYSTEM}{_END}{_HEAD}user{_MID}', {user}, '{_END}'"
        f"{reply}{opened})"
    )


@query(
    "instruction_messages",
    f"""WITH {sq.EN_CLEAN}, t AS (SELECT id, unnest([
      {{'turn': 0, 'role': 'system', 'content': '{_SYSTEM}'}},
      {{'turn': 1, 'role': 'user', 'content': concat('{fixed.INSTRUCTION}', chr(10), chr(10), 'Text: ', input)}},
      {{'turn': 2, 'role': 'assistant', 'content': label}}]) AS m FROM en)
    SELECT id, CAST(m.turn AS BIGINT) AS turn, m.role AS role, m.content AS content FROM t""",
)
def _(spark, sf):
    rows = combine.to_instructions(datasets.english_clean(fx.en_raw(spark, sf), folder=scratch_path(spark, "surplus")), "input", "label", ("id",))
    rows = rows.filter(chat.require_fields(F.col("instruction"), F.col("input"), F.col("output")))
    messages = chat.to_messages(F.col("instruction"), F.col("input"), F.col("output"))
    return rows.select("id", F.posexplode(messages).alias("turn", "m")).select(
        "id", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content"
    )


@query("chat_train_text", f"WITH {sq.EN_CLEAN} SELECT id, {_sql_chat('input', 'label')} AS text FROM en")
def _(spark, sf):
    rows = combine.to_instructions(datasets.english_clean(fx.en_raw(spark, sf), folder=scratch_path(spark, "surplus")), "input", "label", ("id",))
    messages = chat.to_messages(F.col("instruction"), F.col("input"), F.col("output"))
    return rows.select("id", chat.render_chat(messages).alias("text"))


@query("chat_prompt_text", f"SELECT conv_id, turn, {_sql_chat('text', None)} AS prompt FROM conversations")
def _(spark, sf):
    turns = fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.lit(fixed.INSTRUCTION).alias("instruction"), F.col("text").alias("input")
    )
    return evaluation.with_prompt(turns).select("conv_id", "turn", "prompt")


# --- prompts, inference, synthetic rows -----------------------------------------------------


@query(
    "prompt_schedule",
    """SELECT i AS attempt, item_id AS prompt_no, text AS prompt
    FROM (SELECT unnest(range((800 // 5 + (SELECT count(*) FROM benchmark)) * 5)) AS i) a
    JOIN benchmark b ON b.item_id = (i // 5) % (SELECT count(*) FROM benchmark)""",
)
def _(spark, sf):
    return generation.prompt_schedule(fx.prompts(spark, sf)).select("attempt", "prompt_no", "prompt")


@query(
    "collect_unique",
    "SELECT text, min(doc_id) AS attempt FROM documents GROUP BY text ORDER BY attempt LIMIT 800",
)
def _(spark, sf):
    return generation.collect_unique(documents(spark, sf).withColumnRenamed("id", "attempt"), 800)


@query(
    "generated_snippets",
    f"""WITH a AS (SELECT doc_id AS id, text AS raw, concat('Go on: ', split_part(text, ' ', 1)) AS prompt FROM documents),
    b AS (SELECT id, {sq.strip('raw')} AS s, {sq.strip("regexp_extract(prompt, '[^:]*$')")} AS tail FROM a),
    c AS (SELECT id, CASE WHEN tail <> '' AND starts_with(s, tail)
      THEN {sq.strip("substring(s, length(tail) + 1)")} ELSE s END AS text FROM b)
    SELECT id, text FROM c WHERE {sq.words('text')} > 3""",
)
def _(spark, sf):
    attempts = documents(spark, sf).select(
        "id",
        F.col("text").alias("raw"),
        F.concat(F.lit("Go on: "), F.substring_index("text", " ", 1)).alias("prompt"),
    )
    return generation.snippets(attempts).select("id", "text")


@query(
    "label_prompts",
    f"SELECT doc_id AS id, concat('Instruction: {fixed.INSTRUCTION}', chr(10), 'News: ', text, chr(10), 'Sentiment:') AS prompt FROM documents",
)
def _(spark, sf):
    return documents(spark, sf).select("id", chat.label_prompt(F.col("text")).alias("prompt"))


_CLEAN_LABEL = f"translate(lower(regexp_extract(baseline_raw_output, '[^{sq.SPACE}]+')), '.,', '')"


@query(
    "clean_labels",
    f"""WITH {sq.ANSWERED} SELECT id, baseline_raw_output AS raw, {_CLEAN_LABEL} AS label FROM answers
    WHERE regexp_extract(baseline_raw_output, '[^{sq.SPACE}]+') <> ''""",
)
def _(spark, sf):
    raw = F.col("baseline_raw_output")
    rows = fx.answers(spark, sf).select("id", raw.alias("raw"), lb.clean_label(raw).alias("label"))
    return rows.filter(F.col("label").isNotNull())


_MADE = f"""{sq.ANSWERED}, made AS (
  SELECT id, '{fixed.INSTRUCTION}' AS instruction, input_text AS input, baseline_raw_output AS output_raw_llm,
    {_CLEAN_LABEL} AS output FROM answers
  WHERE regexp_extract(baseline_raw_output, '[^{sq.SPACE}]+') <> ''),
checked AS (SELECT *, output IN ('negative', 'neutral', 'positive') AS label_is_valid,
  {sq.words('input')} AS word_count, {sq.words('input')} BETWEEN 4 AND 80 AS input_length_ok FROM made)"""


def _checked(spark, sf):
    answers = fx.answers(spark, sf).select(
        "id", F.col("input_text").alias("text"), F.col("baseline_raw_output").alias("raw")
    )
    return generation.validated(generation.labelled_rows(answers))


@query("validate_synthetic", f"WITH {_MADE} SELECT * FROM checked")
def _(spark, sf):
    return _checked(spark, sf)


def _proportional_ids(n: int) -> str:
    """``ids``: what a sample of ``n`` rows by class share takes from ``en`` (id, label)."""
    return f"""
    c AS (SELECT label, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, label) AS o FROM en GROUP BY label),
    q AS (SELECT *, CAST(round_even(c / (SELECT sum(c) FROM c) * {n}, 0) AS BIGINT) AS q FROM c),
    d AS (SELECT *, {n} - (SELECT sum(q) FROM q) AS d, row_number() OVER (ORDER BY q, o) AS small FROM q),
    k AS (SELECT label, CASE WHEN (SELECT count(*) FROM en) <= {n} THEN c
      ELSE least(c, CASE WHEN d > 0 AND o = 1 THEN q + d WHEN d < 0 AND small = 1 THEN greatest(q + d, 0) ELSE q END)
      END AS k FROM d),
    r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {sq.draw()}) AS r FROM en),
    taken AS (SELECT id FROM r JOIN k USING (label) WHERE r <= k),
    capped AS (SELECT id FROM taken QUALIFY row_number() OVER (ORDER BY {sq.draw()}) <= {n}),
    more AS (SELECT id, row_number() OVER (ORDER BY {sq.draw()}) AS r FROM en WHERE id NOT IN (SELECT id FROM taken)),
    ids AS (SELECT id FROM capped UNION ALL SELECT id FROM more WHERE r <= {n} - (SELECT count(*) FROM capped))"""


@query(
    "synthetic_finish",
    f"""WITH {_MADE}, f AS (SELECT * FROM checked QUALIFY row_number() OVER (PARTITION BY input ORDER BY id) = 1),
    en AS (SELECT id, instruction, input, output AS label FROM f WHERE label_is_valid AND input_length_ok),
    {_proportional_ids(20)}
    SELECT id, instruction, input, label AS output FROM en WHERE id IN (SELECT id FROM ids)""",
)
def _(spark, sf):
    return synthetic.finish(_checked(spark, sf), 20)


def length_model():
    """A stand-in model for checks: answers by prompt length and fails on some prompts."""

    def load():
        def answer(prompts):
            out = []
            for prompt in prompts:
                if len(prompt) % 7 == 0:
                    raise ValueError("length is a multiple of 7")
                out.append("Positive." if len(prompt) % 2 == 0 else "negative, as told")
            return out

        return answer

    return load


@query(
    "batch_infer",
    """SELECT doc_id AS id,
      CASE WHEN length(text) % 7 = 0 THEN NULL WHEN length(text) % 2 = 0 THEN 'Positive.'
        ELSE 'negative, as told' END AS raw,
      CASE WHEN length(text) % 7 = 0 THEN 'ValueError: length is a multiple of 7' END AS error
    FROM documents""",
)
def _(spark, sf):
    rows = documents(spark, sf).select("id", "text")
    return generation.batch_infer(rows, "text", length_model()).select("id", "raw", "error")


def writer_model():
    """A stand-in generator: the first words of the prompt."""

    def load():
        return lambda prompts: [" ".join(p.split()[: 3 + len(p) % 40]) for p in prompts]

    return load


def labeller_model():
    """A stand-in labeller: answers by prompt length, some answers outside the label set."""

    def load():
        names = ["Positive.", "negative, clearly", "neutral", "unsure"]
        return lambda prompts: [names[len(p) % 4] for p in prompts]

    return load


_WRITTEN = f"""w AS (
  SELECT item_id, array_to_string(list_slice(regexp_extract_all(text, '[^{sq.SPACE}]+'), 1, 3 + length(text) % 40), ' ')
    AS text FROM benchmark WHERE item_id < 6 + (SELECT count(*) FROM benchmark)),
u AS (SELECT text, min(item_id) * 5 AS id FROM w WHERE {sq.words('text')} > 3 GROUP BY text ORDER BY id LIMIT 30),
l AS (SELECT id, text AS input, ['Positive.', 'negative, clearly', 'neutral', 'unsure'][
    length(concat('Instruction: {fixed.INSTRUCTION}', chr(10), 'News: ', text, chr(10), 'Sentiment:')) % 4 + 1] AS raw
  FROM u),
lab AS (SELECT id, input, translate(lower(regexp_extract(raw, '[^{sq.SPACE}]+')), '.,', '') AS label FROM l),
en AS (SELECT * FROM lab WHERE label IN ('negative', 'neutral', 'positive') AND {sq.words('input')} BETWEEN 4 AND 80)"""


@query(
    "synthetic_build",
    f"""WITH {_WRITTEN}, {_proportional_ids(10)}
    SELECT id, '{fixed.INSTRUCTION}' AS instruction, input, label AS output FROM en WHERE id IN (SELECT id FROM ids)""",
)
def _(spark, sf):
    folder = scratch_path(spark, "synthetic")
    return synthetic.build_synthetic(fx.prompts(spark, sf), writer_model(), labeller_model(), folder, n=10, target=30)


@query("collect_in_waves", f"WITH {_WRITTEN} SELECT text, id AS attempt FROM u")
def _(spark, sf):
    """The first texts of a generator that is asked no further than they need."""
    folder = scratch_path(spark, "waves")
    return generation.collect_in_waves(fx.prompts(spark, sf), writer_model(), folder, 30)


@query(
    "synthetic_checks",
    f"""WITH {_MADE} SELECT count(*) AS rows, count(*) FILTER (NOT label_is_valid) AS invalid_labels,
      count(*) FILTER (NOT input_length_ok) AS invalid_lengths, count(*) - count(DISTINCT input) AS removed_by_dedup
    FROM checked""",
)
def _(spark, sf):
    return synthetic.synthetic_checks(_checked(spark, sf))


@query(
    "synthetic_funnel",
    f"""WITH {_MADE}, f AS (SELECT * FROM checked QUALIFY row_number() OVER (PARTITION BY input ORDER BY id) = 1)
    SELECT CAST(0 AS BIGINT) AS step, 'loaded' AS stage, (SELECT count(*) FROM checked) AS rows_left
    UNION ALL SELECT 1, 'deduplicated', (SELECT count(*) FROM f)
    UNION ALL SELECT 2, 'label_valid', (SELECT count(*) FROM f WHERE label_is_valid)
    UNION ALL SELECT 3, 'length_ok', (SELECT count(*) FROM f WHERE label_is_valid AND input_length_ok)""",
)
def _(spark, sf):
    return synthetic.synthetic_funnel(_checked(spark, sf))


# --- evaluation -----------------------------------------------------------------------------


def _counts(spark, sf):
    return evaluation.counts_of(fx.answers(spark, sf))


@query(
    "parse_predictions",
    f"""WITH {sq.ANSWERED} SELECT id, baseline_raw_output AS raw, {sq.parse('baseline_raw_output')} AS label,
      CAST(CASE {sq.parse('baseline_raw_output')} WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1
        WHEN 'positive' THEN 2 END AS BIGINT) AS class_index
    FROM answers""",
)
def _(spark, sf):
    raw = F.col("baseline_raw_output")
    return (
        fx.answers(spark, sf)
        .select("id", raw.alias("raw"), lb.parse_sentiment(raw).alias("label"))
        .withColumn("class_index", lb.class_index(F.col("label")))
    )


@query(
    "detailed_results",
    f"""WITH {sq.ANSWERED}, p AS (SELECT *, {sq.parse('baseline_raw_output')} AS baseline_prediction,
      {sq.parse('finetuned_raw_output')} AS finetuned_prediction FROM answers)
    SELECT id, language, instruction, input_text, ground_truth, baseline_prediction, baseline_raw_output,
      baseline_prediction = ground_truth AS baseline_correct, finetuned_prediction, finetuned_raw_output,
      finetuned_prediction = ground_truth AS finetuned_correct FROM p""",
)
def _(spark, sf):
    return metrics.detailed_results(fx.answers(spark, sf))


@query(
    "detailed_results_joined",
    f"""WITH {sq.ANSWERED}, told AS (SELECT * REPLACE (CASE WHEN id % 10 <> 3 THEN baseline_raw_output END AS baseline_raw_output)
      FROM answers),
    p AS (SELECT *, {sq.parse("coalesce(baseline_raw_output, '')")} AS baseline_prediction,
      {sq.parse('finetuned_raw_output')} AS finetuned_prediction FROM told)
    SELECT id, language, instruction, input_text, ground_truth, baseline_prediction, baseline_raw_output,
      baseline_prediction = ground_truth AS baseline_correct, finetuned_prediction, finetuned_raw_output,
      finetuned_prediction = ground_truth AS finetuned_correct FROM p""",
)
def _(spark, sf):
    """One model has no answer to some of the examples."""
    told = fx.answers(spark, sf)
    baseline = told.filter("id % 10 <> 3").select("id", F.col("baseline_raw_output").alias("raw"))
    finetuned = told.select("id", F.col("finetuned_raw_output").alias("raw"))
    rows = told.select("id", "language", "instruction", "input_text", "ground_truth")
    folder, buckets = scratch_path(spark, "by-id"), 16
    tables = [
        evaluation.stored_by_id(df, folder, name, buckets)
        for name, df in (("examples", rows), ("baseline", baseline), ("finetuned", finetuned))
    ]
    return metrics.detailed_results(evaluation.joined_answers(*tables, missing="unparseable"))


@query(
    "accuracy_joined",
    f"""WITH {sq.ANSWERED}, told AS (SELECT * REPLACE (CASE WHEN id % 10 <> 3 THEN baseline_raw_output END AS baseline_raw_output)
      FROM answers),
    p AS (SELECT language, ground_truth, {sq.parse("coalesce(baseline_raw_output, '')")} AS baseline,
      {sq.parse('finetuned_raw_output')} AS finetuned FROM told),
    m AS (SELECT language, ground_truth, 'baseline' AS model, baseline AS pred FROM p
      UNION ALL SELECT language, ground_truth, 'finetuned', finetuned FROM p),
    e AS (SELECT * FROM m UNION ALL SELECT 'overall', ground_truth, model, pred FROM m)
    SELECT model, language, count(*) AS rows, count(*) FILTER (pred <> 'unparseable') AS parseable,
      round(count(*) FILTER (pred = ground_truth) / count(*), 6) AS accuracy_all,
      round(count(*) FILTER (pred = ground_truth) / count(*) FILTER (pred <> 'unparseable'), 6) AS accuracy_parseable,
      round(count(*) FILTER (pred = ground_truth) / count(*) FILTER (pred <> 'unparseable'), 6) AS accuracy_reported
    FROM e GROUP BY 1, 2""",
)
def _(spark, sf):
    """Figures alone: no text and no raw answer is joined."""
    told = fx.answers(spark, sf)
    baseline = told.filter("id % 10 <> 3").select("id", F.col("baseline_raw_output").alias("raw"))
    finetuned = told.select("id", F.col("finetuned_raw_output").alias("raw"))
    joined = metrics.with_predictions(told, baseline, finetuned, missing="unparseable")
    counts = metrics.confusion_counts(metrics.melt_predictions(joined, evaluation.PREDICTIONS))
    return six(metrics.accuracies(counts), "accuracy_all", "accuracy_parseable", "accuracy_reported")


@query(
    "unparseable_rate",
    f"""WITH {sq.MELTED} SELECT model, language, count(*) AS rows, count(*) FILTER (pred = 'unparseable') AS unparseable,
      round(count(*) FILTER (pred = 'unparseable') / count(*), 6) AS rate FROM scored GROUP BY 1, 2""",
)
def _(spark, sf):
    return six(metrics.unparseable_rate(_counts(spark, sf)), "rate")


@query(
    "accuracy_both",
    f"""WITH {sq.MELTED} SELECT model, language, rows, parseable, round(accuracy_all, 6) AS accuracy_all,
      round(accuracy_parseable, 6) AS accuracy_parseable, round(accuracy_parseable, 6) AS accuracy_reported FROM acc""",
)
def _(spark, sf):
    return six(metrics.accuracies(_counts(spark, sf)), "accuracy_all", "accuracy_parseable", "accuracy_reported")


@query(
    "accuracy_odd",
    f"""WITH {sq.ANSWERED}, odd AS (SELECT language, CASE WHEN language = 'de' AND id % 17 = 0 THEN 'mixed' ELSE ground_truth END AS truth,
      CASE WHEN language = 'es' THEN 'unparseable' ELSE {sq.parse('baseline_raw_output')} END AS pred FROM answers),
    every AS (SELECT * FROM odd UNION ALL SELECT 'overall', truth, pred FROM odd),
    n AS (SELECT language, count(*) AS rows, count(*) FILTER (pred <> 'unparseable') AS parseable,
      count(*) FILTER (pred = truth) AS hits, count(*) FILTER (pred <> 'unparseable' AND truth = 'mixed') AS mixed
      FROM every GROUP BY 1)
    SELECT 'baseline' AS model, language, rows, parseable, round(hits / rows, 6) AS accuracy_all,
      round(CASE WHEN parseable = 0 THEN 0 ELSE hits / parseable END, 6) AS accuracy_parseable,
      round(CASE WHEN parseable = 0 THEN 0 WHEN mixed > 0 THEN hits / rows ELSE hits / parseable END, 6) AS accuracy_reported
    FROM n""",
)
def _(spark, sf):
    """One language has no parseable answer, another has truths outside the classes."""
    rows = fx.answers(spark, sf)
    mixed = (F.col("language") == "de") & (F.col("id") % 17 == 0)
    rows = rows.withColumn("ground_truth", F.when(mixed, "mixed").otherwise(F.col("ground_truth")))
    mute = F.when(F.col("language") == "es", "unsure").otherwise(F.col("baseline_raw_output"))
    details = metrics.detailed_results(rows.withColumn("baseline_raw_output", mute))
    counts = metrics.confusion_counts(metrics.melt_predictions(details, {"baseline": "baseline_prediction"}))
    return six(metrics.accuracies(counts), "accuracy_all", "accuracy_parseable", "accuracy_reported")


@query(
    "class_report",
    f"""WITH {sq.MELTED} SELECT model, language, class, tp, predicted, support, round(precision, 6) AS precision,
      round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rates""",
)
def _(spark, sf):
    return six(metrics.class_report(_counts(spark, sf)), "precision", "recall", "f1")


@query(
    "avg_report",
    f"""WITH {sq.MELTED} SELECT model, language, 'macro avg' AS average, round(avg(precision), 6) AS precision,
      round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, CAST(sum(support) AS BIGINT) AS support
    FROM rates GROUP BY 1, 2
    UNION ALL SELECT model, language, 'weighted avg', round(sum(precision * support) / sum(support), 6),
      round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
      CAST(sum(support) AS BIGINT) FROM rates GROUP BY 1, 2""",
)
def _(spark, sf):
    return six(metrics.average_report(_counts(spark, sf)), "precision", "recall", "f1")


@query(
    "confusion_dense",
    f"""WITH {sq.MELTED}, l AS (SELECT unnest(['negative', 'neutral', 'positive']) AS c)
    SELECT model, language, t.c AS truth, p.c AS pred, count(*) FILTER (s.truth = t.c AND s.pred = p.c) AS n
    FROM sure s, l t, l p GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    return metrics.confusion_dense(_counts(spark, sf))


@query(
    "micro_report",
    f"""WITH {sq.MELTED}, r AS (
      SELECT model, language, count(*) FILTER (pred = truth AND truth <> 'neutral') AS tp,
        count(*) FILTER (pred <> 'neutral') AS predicted, count(*) FILTER (truth <> 'neutral' AND pred <> 'neutral') AS support
      FROM sure GROUP BY 1, 2)
    SELECT model, language, round(tp / predicted, 6) AS precision, round(tp / support, 6) AS recall,
      round(2 * tp / (predicted + support), 6) AS f1, support FROM r WHERE predicted > support""",
)
def _(spark, sf):
    known = ["negative", "positive"]
    melted = metrics.melt_predictions(metrics.detailed_results(fx.answers(spark, sf)), evaluation.PREDICTIONS)
    report = metrics.average_report(metrics.confusion_counts(melted, known), known)
    return six(report.filter("average = 'micro avg'").drop("average"), "precision", "recall", "f1")


@query(
    "model_comparison",
    f"""WITH {sq.MELTED}, s AS (SELECT * FROM acc JOIN macro USING (model, language))
    SELECT b.language, round(b.accuracy_parseable, 6) AS baseline_accuracy, round(b.macro_f1, 6) AS baseline_macro_f1,
      round(f.accuracy_parseable, 6) AS finetuned_accuracy, round(f.macro_f1, 6) AS finetuned_macro_f1,
      round(f.accuracy_parseable - b.accuracy_parseable, 6) AS accuracy_gain,
      round(f.macro_f1 - b.macro_f1, 6) AS macro_f1_gain
    FROM s b JOIN s f ON b.language = f.language AND b.model = 'baseline' AND f.model = 'finetuned'""",
)
def _(spark, sf):
    wide = metrics.model_comparison(_counts(spark, sf))
    return six(wide, *[c for c in wide.columns if c != "language"])


@query(
    "metric_table",
    f"""WITH {sq.MELTED}, l AS (
      SELECT model, language, 'unparseable_predictions_count' AS metric,
        count(*) FILTER (pred = 'unparseable') AS value FROM scored GROUP BY 1, 2
      UNION ALL SELECT model, language, 'unparseable_predictions_rate',
        count(*) FILTER (pred = 'unparseable') / count(*) FROM scored GROUP BY 1, 2
      UNION ALL SELECT model, language, 'accuracy', accuracy_parseable FROM acc
      UNION ALL SELECT model, language, 'accuracy_all', accuracy_all FROM acc
      UNION ALL SELECT model, language, concat(class, '_precision'), precision FROM rates
      UNION ALL SELECT model, language, concat(class, '_recall'), recall FROM rates
      UNION ALL SELECT model, language, concat(class, '_f1-score'), f1 FROM rates
      UNION ALL SELECT model, language, concat(class, '_support'), support FROM rates
      UNION ALL SELECT model, language, 'macro_avg_precision', avg(precision) FROM rates GROUP BY 1, 2
      UNION ALL SELECT model, language, 'macro_avg_recall', avg(recall) FROM rates GROUP BY 1, 2
      UNION ALL SELECT model, language, 'macro_avg_f1-score', avg(f1) FROM rates GROUP BY 1, 2
      UNION ALL SELECT model, language, 'macro_avg_support', sum(support) FROM rates GROUP BY 1, 2
      UNION ALL SELECT model, language, 'weighted_avg_precision', sum(precision * support) / sum(support) FROM rates GROUP BY 1, 2
      UNION ALL SELECT model, language, 'weighted_avg_recall', sum(recall * support) / sum(support) FROM rates GROUP BY 1, 2
      UNION ALL SELECT model, language, 'weighted_avg_f1-score', sum(f1 * support) / sum(support) FROM rates GROUP BY 1, 2
      UNION ALL SELECT model, language, 'weighted_avg_support', sum(support) FROM rates GROUP BY 1, 2)
    SELECT concat(language, '_', model, '_', metric) AS key, model, language, metric,
      round(CAST(value AS DOUBLE), 6) AS value FROM l""",
)
def _(spark, sf):
    return six(metrics.metric_table(_counts(spark, sf)), "value")


def answer_model(shift: int):
    """A stand-in classifier: answers by prompt length."""

    def load():
        names = ["positive", "Negative.", "it is neutral", "no idea"]
        return lambda prompts: [names[(len(p) + shift) % 4] for p in prompts]

    return load


def _sql_answer(shift: int) -> str:
    return f"['positive', 'Negative.', 'it is neutral', 'no idea'][(length(prompt) + {shift}) % 4 + 1]"


@query(
    "model_run",
    f"""WITH {sq.EN_CLEAN}, {sq.VI_CLEAN}, {sq.balanced('en', 'es', *EN_QUOTA)}, {sq.scarce_first('vi', 'vs', *VI_QUOTA)},
    rows AS (SELECT 'EN' AS language, en.input, es.label FROM es JOIN en USING (id) WHERE split = 'eval'
      UNION ALL SELECT 'VI', vi.input, vs.label FROM vs JOIN vi USING (id) WHERE split = 'eval'),
    asked AS (SELECT language, label, {_sql_chat('input', None)} AS prompt FROM rows),
    told AS (SELECT language, label, 'baseline' AS model, {_sql_answer(0)} AS raw FROM asked
      UNION ALL SELECT language, label, 'finetuned', {_sql_answer(1)} FROM asked),
    one AS (SELECT language, label, model, {sq.parse('raw')} AS pred FROM told),
    every AS (SELECT * FROM one UNION ALL SELECT 'overall', label, model, pred FROM one)
    SELECT model, language, count(*) AS rows, count(*) FILTER (pred <> 'unparseable') AS parseable,
      round(count(*) FILTER (pred = label) / count(*), 6) AS accuracy_all,
      round(count(*) FILTER (pred = label) / count(*) FILTER (pred <> 'unparseable'), 6) AS accuracy_parseable,
      round(count(*) FILTER (pred = label) / count(*) FILTER (pred <> 'unparseable'), 6) AS accuracy_reported
    FROM every GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = dataset_build(spark, sf).filter("split = 'eval'")
    tables = evaluation.run_models(rows, answer_model(0), answer_model(1), scratch_path(spark, "evaluation"))
    return six(tables["accuracy"], "accuracy_all", "accuracy_parseable", "accuracy_reported")


# --- sources and sinks ----------------------------------------------------------------------


def _instructions(spark, sf):
    return fx.en_raw(spark, sf).select(F.lit(fixed.INSTRUCTION).alias("instruction"), "input", "output")


_INSTRUCTION_SQL = f"WITH {sq.EN_RAW} SELECT '{fixed.INSTRUCTION}' AS instruction, input, output FROM en_raw"


@query("jsonl_roundtrip", _INSTRUCTION_SQL)
def _(spark, sf):
    path = scratch_path(spark, "jsonl")
    writers.write_jsonl(_instructions(spark, sf), path)
    return readers.read_instructions(spark, path)


@query("csv_roundtrip", _INSTRUCTION_SQL)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_csv(_instructions(spark, sf), path)
    return readers.read_csv(spark, path)


#: Records by id: not closed, without an input, with nulls, or whole.
_LINES = """lines AS (SELECT doc_id, concat('{"instruction":"i', doc_id, CASE doc_id % 7
    WHEN 0 THEN concat('","input":"', sha256(text)) WHEN 1 THEN concat('","output":"', lang, '"}')
    WHEN 2 THEN '","input":null,"output":null}' ELSE concat('","input":"', sha256(text), '","output":"', lang, '"}') END) AS line
  FROM documents)"""


@query(
    "instruction_rejects",
    f"""WITH {_LINES} SELECT CASE doc_id % 7 WHEN 0 THEN 'malformed' WHEN 1 THEN 'lacks input' WHEN 2 THEN 'lacks input, output' END AS reason,
      CASE doc_id % 7 WHEN 0 THEN line WHEN 1 THEN concat('{{"instruction":"i', doc_id, '","input":null,"output":"', lang, '"}}')
      ELSE line END AS record
    FROM lines JOIN documents USING (doc_id)""",
)
def _(spark, sf):
    """Good records (without a reason) and rejects of JSON lines, a part of which is broken."""
    path = scratch_path(spark, "lines")
    number, digest = F.col("doc_id").cast("string"), F.sha2("text", 256)
    rest = (
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('","input":"'), digest))
        .when(F.col("doc_id") % 7 == 1, F.concat(F.lit('","output":"'), "lang", F.lit('"}')))
        .when(F.col("doc_id") % 7 == 2, F.lit('","input":null,"output":null}'))
        .otherwise(F.concat(F.lit('","input":"'), digest, F.lit('","output":"'), "lang", F.lit('"}')))
    )
    line = F.concat(F.lit('{"instruction":"i'), number, rest)
    fx.table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    read = readers.check_instructions(spark, path, scratch_path(spark, "checked"))
    good = read.good.select(F.lit(None).cast("string").alias("reason"), F.to_json(F.struct("*")).alias("record"))
    return good.unionByName(read.rejects.select("reason", "record"))


@query(
    "csv_rejects",
    """SELECT CASE doc_id % 5 WHEN 0 THEN 'malformed' WHEN 1 THEN 'lacks output' END AS reason, count(*) AS rows,
      CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY 1""",
)
def _(spark, sf):
    """Good rows and rejects of a CSV file, a part of whose rows has a field too many or an empty one."""
    path = scratch_path(spark, "csv-lines")
    number = F.col("doc_id").cast("string")
    more = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(",x,"), "lang")).when(F.col("doc_id") % 5 == 1, F.lit(",")).otherwise(
        F.concat(F.lit(","), "lang")
    )
    rows = fx.table(spark, sf, "documents").select(
        "doc_id", F.concat(number, F.lit(','), F.lit('"a ""quoted"" text"'), more).alias("value")
    )
    # Files of at most 500 rows, each with the header.
    body = F.array_join(F.collect_list("value"), "\n")
    files = rows.groupBy(F.floor(F.col("doc_id") / 500).alias("file")).agg(
        F.concat(F.lit("instruction,input,output\n"), body).alias("value")
    )
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    read = readers.check_csv(spark, path, scratch_path(spark, "checked"))
    good = read.good.select(F.lit(None).cast("string").alias("reason"), F.col("instruction").cast("bigint").alias("id"))
    bad = read.rejects.select("reason", F.regexp_extract("record", "[0-9]+", 0).cast("bigint").alias("id"))
    counted = good.unionByName(bad).groupBy("reason")
    return counted.agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"))


@query(
    "shuffled_files",
    _BUILT
    + """ SELECT split, row_number() OVER (PARTITION BY split ORDER BY md5(concat('42:', language, ':', id)), concat(language, ':', id))
      AS position, language, id FROM built""",
)
def _(spark, sf):
    """Where each row of a dataset stands when the files of its split are read in the order of their names."""
    path = scratch_path(spark, "dataset")
    datasets.write_dataset(dataset_build(spark, sf), path, files=4)
    rows = readers.read_dataset(spark, path).select("split", "language", "id", "_metadata.file_name", "_metadata.file_block_start")
    # A file this small is one block, read in one task; the window is over the quota's narrow rows.
    at = rows.withColumn("_at", F.monotonically_increasing_id())
    order = Window.partitionBy("split").orderBy("file_name", "file_block_start", "_at")
    return at.select("split", F.row_number().over(order).cast("bigint").alias("position"), "language", "id")


@query("splits_roundtrip", f"WITH {sq.VI_RAW} SELECT id, sentence, sentiment, topic, split FROM vi_raw")
def _(spark, sf):
    path = scratch_path(spark, "splits")
    fx.vi_raw(spark, sf).write.partitionBy("split").parquet(path)
    return readers.read_all_splits(spark, {s: f"{path}/split={s}" for s in ("train", "validation", "test")})


@query("results_roundtrip", SQL["detailed_results"])
def _(spark, sf):
    path = scratch_path(spark, "results")
    writers.write_results(metrics.detailed_results(fx.answers(spark, sf)), path)
    columns = metrics.detailed_results(fx.answers(spark, sf)).columns
    return spark.read.parquet(path).select(columns)


# --- whole runs from written files ----------------------------------------------------------


@query(
    "training_files",
    _BUILT
    + f""", {sq.ANSWERED}
    SELECT split, 'original' AS source, {_sql_chat('input', 'output')} AS text FROM built
    UNION ALL SELECT 'train', 'synthetic', {_sql_chat('input_text', 'ground_truth').replace(fixed.INSTRUCTION, 'label it')} FROM answers""",
)
def _(spark, sf):
    """Write a dataset and synthetic rows, read both back and render them as chat texts."""
    dataset, made = scratch_path(spark, "dataset"), scratch_path(spark, "synthetic-csv")
    datasets.write_dataset(dataset_build(spark, sf), dataset)
    rows = fx.answers(spark, sf)
    writers.write_csv(
        rows.select("instruction", F.col("input_text").alias("input"), F.col("ground_truth").alias("output")), made
    )
    return datasets.prepare_training(spark, dataset, made)


@query("evaluation_files", SQL["model_run"])
def _(spark, sf):
    """Write a dataset and score both models on its eval files."""
    path = scratch_path(spark, "dataset")
    datasets.write_dataset(dataset_build(spark, sf), path)
    tables = evaluation.evaluate_files(spark, path, answer_model(0), answer_model(1), scratch_path(spark, "evaluation"))
    return six(tables["accuracy"], "accuracy_all", "accuracy_parseable", "accuracy_reported")
