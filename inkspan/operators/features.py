"""Features of documents in long form: (doc_id, feature, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import grams_of, pieces_of, word_list, word_runs
from inkspan.sources.staging import stage
from inkspan.sources.tables import dealt

# Names of the stop word lists that come with Spark.
SPARK_LISTS = {"da": "danish", "de": "german", "en": "english", "es": "spanish", "fr": "french"}

# Extension groups and their codes; everything else is 0.
EXTENSION_GROUPS = {
    "Document": ["doc", "docx", "odt", "pdf", "rtf", "txt"],
    "Presentation": ["odp", "ppt", "pptx"],
    "Spreadsheet": ["csv", "ods", "xls", "xlsx"],
    "Hypertext": ["htm", "html", "xml"],
}


def spark_stop_words(lang: str) -> list[str]:
    """The list shipped with Spark for a language, empty if there is none."""
    name = SPARK_LISTS.get(lang)
    return [w.strip() for w in StopWordsRemover.loadDefaultStopWords(name)] if name else []


def cut_words(words: Column, cut: int | None) -> Column:
    """The first ``cut`` words when a cut is configured, else all of them."""
    return F.slice(words, 1, cut) if cut else words


def tokenize_cut(text: Column, cut: int | None = None) -> Column:
    return F.array_join(cut_words(word_list(text), cut), " ")


def without_stop_words(words: Column, lang: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """Drop the stop words of the document's own language; other languages keep all words."""
    def keep(stop: Sequence[str]):
        return lambda w: ~w.isin(*stop)

    out = None
    for code, stop in lists.items():
        if not stop:
            continue
        kept = F.filter(words, keep(stop))
        out = F.when(lang == code, kept) if out is None else out.when(lang == code, kept)
    return words if out is None else out.otherwise(words)


def ngrams(words: Column, low: int, high: int, lead: Column | None = None) -> Column:
    """All word n-grams for n in [low, high], joined by spaces; none of the first ``lead`` words alone."""
    lead = F.lit(0) if lead is None else lead
    return F.concat(*[grams_of(words, n, lead) for n in range(low, high + 1)])


def term_counts(
    docs: DataFrame,
    text: str = "text",
    ngram_range: tuple[int, int] = (1, 1),
    cut: int | None = None,
    stop_words: Mapping[str, Sequence[str]] | None = None,
    min_chars: int = 2,
) -> DataFrame:
    """(doc_id, term, tf). Stop words and short words go before n-grams are formed.

    Words are read piece by piece, and a piece is given the last words before it, so long documents never become
    one array. Texts are dealt by document, and counted where they are: words are not shuffled.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    source = dealt(docs.select("doc_id", lang.alias("lang"), F.col(text).alias("_text")), "doc_id")

    def kept(piece: Column, before: Column) -> Column:
        words = word_list(piece)
        if cut:
            words = F.slice(words, F.lit(1), F.greatest(F.lit(cut) - before, F.lit(0)))
        return without_stop_words(F.filter(words, lambda w: F.length(w) >= min_chars), F.col("lang"), stop_words or {})

    runs = word_runs(source, ["doc_id", "lang"], ngram_range[1] - 1, "_text", kept, counted=bool(cut))
    terms = runs.select("doc_id", F.explode(ngrams(F.col("words"), *ngram_range, F.col("lead"))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


BUCKETS = 1 << 20  # of terms, counted together before terms are counted alone


def fit_tfidf(
    counts: DataFrame, docs: DataFrame, min_df: float = 0.01, max_df: float = 1.0
) -> DataFrame:
    """Vocabulary with document frequency and smoothed idf: (term, df, idf).

    Frequencies are limits as shares of all documents, documents without terms included.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    # A term has no more documents than all terms of its bucket together; most terms are too rare to be counted by name.
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("_bucket")
    heavy = counts.groupBy(bucket).agg(F.count(F.lit(1)).alias("_pairs")).withColumn("_n", total)
    heavy = stage(heavy.filter(F.col("_pairs") >= min_df * F.col("_n")).select("_bucket"), "buckets")
    likely = counts.select("term", bucket).join(heavy, "_bucket", "left_semi")
    seen = likely.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sized = seen.withColumn("_n", total)
    return sized.filter((F.col("df") >= min_df * F.col("_n")) & (F.col("df") <= max_df * F.col("_n"))).select(
        "term", "df", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf")
    )


def transform_tfidf(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, term, value) with unit length per document; terms outside the vocabulary are ignored.

    Terms are dealt by document into parts that follow the input, so a task sorts as many of them, however large the input is.
    """
    raw = counts.join(vocabulary.select("term", "idf"), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    raw = dealt(raw.select("doc_id", "term", "raw"), "doc_id")
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("raw") / length).alias("value"))


def tfidf(docs: DataFrame, text: str = "text", min_df: float = 0.01, max_df: float = 1.0, **options) -> DataFrame:
    """Fit and transform on the same documents.

    Counts are staged, so texts are tokenized once; the vocabulary is staged, so its real size
    decides whether it is broadcast to the counts.
    """
    counts = stage(term_counts(docs, text, **options), "term-counts")
    return transform_tfidf(counts, stage(fit_tfidf(counts, docs, min_df, max_df), "vocabulary"))


def extension_code(ext: Column) -> Column:
    """1 document, 2 presentation, 3 spreadsheet, 4 hypertext, else 0."""
    names = list(EXTENSION_GROUPS)
    code = F.when(ext.isin(*EXTENSION_GROUPS[names[0]]), 1)
    for i, name in enumerate(names[1:], start=2):
        code = code.when(ext.isin(*EXTENSION_GROUPS[name]), i)
    return code.otherwise(0)


def custom_features(docs: DataFrame, features: Mapping[str, Column] | None) -> DataFrame:
    """User features as (doc_id, feature, value); each is a column expression or a pandas UDF call."""
    if not features:
        return docs.select("doc_id", F.lit("").alias("feature"), F.lit(0.0).alias("value")).filter("false")
    entries = [F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value")) for n, c in features.items()]
    return docs.select("doc_id", F.inline(F.array(*entries)))


def vectorized_features(
    docs: DataFrame, make: Callable[[], Callable[[list[str]], Iterable[Mapping[str, float]]]], text: str = "text"
) -> DataFrame:
    """(doc_id, feature, value) of a user's own vectorizer.

    ``make`` is called once per task and gives a function from a list of texts to a mapping of feature to value for each of them;
    zeros are left out. Texts reach it in Arrow batches; a null text is an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        vectorize = make()
        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            found = list(vectorize([t or "" for t in texts]))
            if len(found) != len(ids):
                raise ValueError("the vectorizer has to give one mapping for each text")
            rows = [(i, str(f), float(v)) for i, own in zip(ids, found, strict=True) for f, v in own.items() if v]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            kinds = [batch.schema.field("doc_id").type, pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "feature", "value"])

    rows = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, feature string, value double")


def assemble_features(text: DataFrame, title: DataFrame, custom: DataFrame) -> DataFrame:
    """Stack the three families side by side; prefixes keep their features apart."""
    def prefixed(df: DataFrame, prefix: str, name: str) -> DataFrame:
        return df.select("doc_id", F.concat(F.lit(prefix + ":"), F.col(name)).alias("feature"), "value")

    return (
        prefixed(text, "text", "term")
        .unionByName(prefixed(title, "title", "term"))
        .unionByName(prefixed(custom, "custom", "feature"))
    )


def chi2_scores(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(feature, score): chi-square of feature sums per class against class shares.

    Sums combine on the map side; what is left is one row per feature and class.
    """
    total = labels.agg(F.count(F.lit(1)).alias("n")).scalar()
    classes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_size")).withColumn("share", F.col("_size") / total)
    observed = features.join(labels.select("doc_id", "label"), "doc_id").groupBy("feature", "label").agg(
        F.sum("value").alias("observed")
    )
    # a class in which the feature never occurs has observed 0 and adds its expected value;
    # those classes together make up 1 minus the shares seen
    per_class = observed.join(classes.select("label", "share"), "label")
    sums = Window.partitionBy("feature")
    expected = F.col("share") * F.sum("observed").over(sums)
    parts = per_class.withColumns({"expected": expected, "sum": F.sum("observed").over(sums)})
    deviation = F.col("observed") - F.col("expected")
    return parts.groupBy("feature").agg(
        (F.sum(deviation * deviation / F.col("expected")) + F.first("sum") * (1 - F.sum("share"))).alias("score")
    )


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """The k features with the highest score; ties by name."""
    return scores.orderBy(F.col("score").desc(), "feature").limit(k)


WORD_STRETCH = 8_192  # distinct words of a text worked on at once


def _word_matrix(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A fixed random vector of unit length for each word (64-bit hashes): no two runs or machines differ."""
    at = words[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    at = (at ^ (at >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    at = (at ^ (at >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    drawn = ((at ^ (at >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) - 0.5
    return drawn / np.sqrt((drawn**2).sum(axis=1, keepdims=True))


def fit_vector(counts: np.ndarray, words: np.ndarray, size: int, seed: int, steps: int, ridge: float = 0.05) -> np.ndarray:
    """The vector under which a document's words are likely against a fixed word matrix.

    Gradient steps on the mean of ``log sigmoid(d . w)`` over all words less ``ridge / 2 |d|^2``, which stands for words drawn at
    random; the start is zero, so nothing is left to chance.
    """
    vector, total = np.zeros(size), max(1, counts.sum())
    for _ in range(steps if len(words) else 0):
        pull = np.zeros(size)
        for k in range(0, len(words), WORD_STRETCH):
            part = _word_matrix(words[k : k + WORD_STRETCH], size, seed)
            pull += (counts[k : k + WORD_STRETCH] / (1 + np.exp(part @ vector))) @ part
        vector = vector + 2.0 * (pull / total - ridge * vector)
    return vector


def document_vectors(docs: DataFrame, text: str = "text", size: int = 32, seed: int = 7, iterations: int = 12) -> DataFrame:
    """(doc_id, vector): a vector fitted for each document against a fixed word matrix, in one pass without a vocabulary.

    The result depends on the text and the seed alone, whatever the cores and partitions. A text without words has the zero
    vector.
    """
    counted = token_counts(docs, text)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, words, counts = batch.column("doc_id"), batch.column("words"), batch.column("counts")
            out = [
                fit_vector(c.values.to_numpy().astype(float), w.values.to_numpy().view(np.uint64), size, seed, iterations).tolist()
                for w, c in zip(words, counts, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.float64()))], ["doc_id", "vector"])

    return counted.mapInArrow(run, f"doc_id {kind}, vector array<double>")


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, words, counts): hashes of a document's distinct words in order, and how often each stands. Read piece by piece."""
    pieces = dealt(docs.select("doc_id", F.col(text).alias("_text")), "doc_id").select("doc_id", F.explode(pieces_of(F.col("_text"))).alias("_piece"))
    words = pieces.select("doc_id", F.explode(word_list(F.col("_piece"))).alias("_word"))
    each = words.groupBy("doc_id", F.xxhash64("_word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    packed = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("w"))
    none = F.array().cast("array<bigint>")
    return docs.select("doc_id").join(packed, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("w.word"), none).alias("words"), F.coalesce(F.col("w.n"), none).alias("counts")
    )
