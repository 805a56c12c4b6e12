"""Citations in answers: extraction, labels, and their place in the pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.sources import shared

# The two forms of a citation tag.
TAGS = [
    r"""<citation\s+pdf_name="([^"]+)"\s+page_number="([^"]+)"\s+chunk_id="([^"]+)"\s+cited_text="(.*?)">""",
    r"""<citation\s+pdf_name='([^']+)'\s+page_number='([^']+)'\s+chunk_id='([^']+)'\s+cited_text='(.*?)'>""",
]
PARTS = ["pdf_name", "page_number", "chunk_id", "cited_text"]


def extract(answers: DataFrame) -> DataFrame:
    """(answer_id, pdf_name, page_number, chunk_id, cited_text) of all tags in the answers, of either quote."""
    out = None
    for tag in TAGS:
        groups = [F.regexp_extract_all("answer", F.lit(tag), F.lit(k)).alias(name) for k, name in enumerate(PARTS, 1)]
        rows = answers.select("answer_id", F.explode(F.arrays_zip(*groups)).alias("z")).select("answer_id", *(F.col(f"z.{name}") for name in PARTS))
        out = rows if out is None else out.unionByName(rows)
    return out


def label(name: Column) -> Column:
    """The document's name without its ending, cut to 25 characters."""
    bare = F.regexp_replace(name, r"(?i)\.pdf$", "")
    return F.when(F.length(bare) > 25, F.concat(F.substring(bare, 1, 22), F.lit("..."))).otherwise(bare)


def tooltip(text: Column) -> Column:
    """The trimmed text, cut to 147 characters if it has more than 150, with dots after it; null if it is blank."""
    t = X.stripped(text)
    return F.when(t != "", F.concat(F.when(F.length(t) > 150, F.substring(t, 1, 147)).otherwise(t), F.lit("...")))


def normal(text: Column) -> Column:
    """White space, quotes and dashes made alike, special marks dropped, lower case, trimmed."""
    t = F.regexp_replace(text, r"\s+", " ")
    t = F.regexp_replace(F.regexp_replace(t, "[\"']", '"'), r"[\x{2013}\x{2014}]", "-")
    return F.btrim(F.lower(F.regexp_replace(t, r"[^A-Za-z0-9_\s\-\".,;:!?()\[\]]", "")), F.lit(" "))


def only_words(text: Column) -> Column:
    return F.lower(F.array_join(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0)), " "))


#: Words of the parts of a cited text that are looked for one after the other.
HEADS = (15, 10, 7, 5)


def cited_forms(text: Column) -> Column:
    """The forms in which a cited text is looked for: itself, normalised, words only, its first words, its first longer words."""
    w = F.split(text, r"\s+")
    heads = [F.when(F.size(w) >= n, normal(F.array_join(F.slice(w, 1, n), " "))).alias(f"head_{n}") for n in HEADS]
    only = only_words(text)
    long = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]{3,}"), F.lit(0)), 1, 5), " ")
    return F.struct(text.alias("text"), normal(text).alias("normal"), F.when(F.length(only) >= 10, only).alias("words"), *heads, F.when(F.length(long) >= 10, normal(long)).alias("long"))


def strategy(page: Column, page_normal: Column, page_words: Column, cited: Column) -> Column:
    """The first of the ways in which the page holds the cited text's forms, or null."""
    ways = [(page, "text"), (page_normal, "normal"), (page_words, "words"), *((page_normal, f"head_{n}") for n in HEADS), (page_normal, "long")]
    out = None
    for k, (where, form) in enumerate(ways, 1):
        held = F.contains(where, cited[form])
        out = F.when(held, k) if out is None else out.when(held, k)
    return out


#: Letters on both sides of a gap by which texts of two or three words are found.
EDGE = 3


def pair(a: Column, b: Column) -> Column:
    return F.concat_ws(" ", a, b)


def edge(a: Column, b: Column) -> Column:
    """The letters on both sides of the gap between two words; null where a word is shorter."""
    return F.when((F.length(a) >= EDGE) & (F.length(b) >= EDGE), F.concat_ws("~", F.right(a, F.lit(EDGE)), F.left(b, F.lit(EDGE))))


def sides(words: Column) -> Column:
    """Each word but the last with the one after it."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.arrays_zip(F.slice(words, F.lit(1), n).alias("a"), F.slice(words, F.lit(2), n).alias("b"))


def asked_key(words: Column) -> Column:
    """What a text that holds these words one after the other, the first and the last maybe within longer ones, has among its pairs and edges; null if unknown."""
    get = lambda k: F.get(words, F.lit(k))
    return F.when(F.size(words) >= 4, pair(get(1), get(2))).when(F.size(words) >= 2, F.coalesce(edge(get(0), get(1)), F.when(F.size(words) == 3, edge(get(1), get(2)))))


def locate(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """Each citation of five characters or more with the page, its own or a neighbour, that holds it: the page before, its own, the next.

    Citations don't meet all texts of a page: a text that holds one of a cited text's forms has two of the form's words side by side, or the letters on both
    sides of a gap. What holds the text itself or any of its heads holds the shortest head, normalised, so three forms are asked: that head, the words and the longer
    words. Only forms without such a pair (of one word, or up to three with very short ones) meet the texts of their pages one by one. Forms of a page's text are
    made once, when it meets its citations.
    """
    spark, c = pages.sparkSession, F.col
    folder = shared.scratch(spark, "citations")
    own, here = ["pdf_name", "page", "cited_text"], ["pdf_name", "try_page"]
    pages.select(c("pdf_filename").alias("pdf_name"), c("page_number").cast("bigint").alias("try_page"), "content").filter("content is not null").withColumn("pid", F.monotonically_increasing_id()).write.parquet(f"{folder}/pages")
    p = spark.read.parquet(f"{folder}/pages")
    told = citations.filter(F.length("cited_text") >= 5).withColumn("page", c("page_number").cast("bigint"))
    known = told.select(*own).distinct().withColumn("cited", cited_forms(c("cited_text"))).withColumn("head", F.coalesce(c(f"cited.head_{HEADS[-1]}"), c("cited.normal")))

    runs = lambda text: F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    forms = known.select(*own, "cited", F.explode(F.array("head", "cited.words", "cited.long")).alias("form")).filter("form is not null").withColumn("runs", runs(c("form")))
    asked = forms.select(*own, "cited", asked_key(c("runs")).alias("key")).distinct().withColumn("try_page", F.explode(F.sequence(c("page") - 1, c("page") + 1)))
    spot = F.xxhash64(*here, "key").alias("spot")
    both = p.select(*here, "pid", F.concat(sides(runs(normal(c("content")))), sides(F.split(only_words(c("content")), " "))).alias("sides"))
    keys = F.array_distinct(F.flatten(F.transform("sides", lambda x: F.array(pair(x["a"], x["b"]), edge(x["a"], x["b"])))))
    index = both.select(*here, "pid", F.explode(keys).alias("key")).filter("key is not null").select("pid", spot)
    met = asked.filter("key is not null").select(spot, *here, "cited").join(index, "spot").select(*here, "cited", "pid")
    met = met.union(asked.filter("key is null").join(p.select(*here, "pid"), here).select(*here, "cited", "pid"))
    texts = met.groupBy("pid", *here).agg(F.collect_set("cited").alias("all")).join(p.select("pid", "content", c("pdf_name").alias("_pdf"), c("try_page").alias("_page")), "pid").filter("pdf_name = _pdf and try_page = _page")
    texts = texts.select(*here, "all", "content", normal(c("content")).alias("page_normal"), only_words(c("content")).alias("page_words"))
    tried = texts.select(*here, "content", "page_normal", "page_words", F.explode("all").alias("cited"))
    tried = tried.withColumn("strategy", strategy(c("content"), c("page_normal"), c("page_words"), c("cited"))).filter("strategy is not null")
    best = tried.groupBy(*here, c("cited.text").alias("cited_text")).agg(F.min("strategy").alias("strategy"))
    wide = told.withColumn("try_page", F.explode(F.sequence(c("page") - 1, c("page") + 1))).join(best, [*here, "cited_text"])
    return wide.groupBy("answer_id", "pdf_name", "page_number", "chunk_id").agg(F.min(F.struct(c("try_page").alias("found_page"), "strategy")).alias("f")).select("answer_id", "pdf_name", "chunk_id", c("page_number").cast("bigint").alias("page_number"), "f.found_page", c("f.strategy").cast("bigint").alias("strategy"))
