"""URL filters by host word segmentation and naive Bayes (operator 7).

Rules decide first: a rule ``host/path`` fits its host and all subdomains where the url's path
starts with the rule's path; the longest fitting rule wins. Other urls get the method's verdict:

1. Host labels are split at hyphens, and each piece by a unigram Viterbi into words. The unigrams
   are counted over all pages from what is already apart: the words of the pages' text, the words
   of paths, and the pieces of hyphenated labels, each distinct label once. A label that is one
   piece is no word by itself, so a concatenation on many hosts is still split. The seeds are words.
2. A multinomial naive Bayes with add-one smoothing scores the words of host and path. It is
   trained on all pages: a page that a rule decides has the rule's verdict; of the others those
   whose host has a seed count as blocked and the rest as allowed. The seeds only mark examples:
   what decides is the score, so words that keep company with blocked pages block pages without a
   seed, and a seed that rules mostly allow does not block.

Words and their counts are tables of any size: the substrings of distinct pieces are joined to the
unigrams, and the words of distinct urls to their log odds. Keys with many rows are joined by a
broadcast of fewer than a thousand of them. A piece has at most 63 letters, as names do; what is
longer is no name and stays whole.

Defined results: a null url or one without ``://`` has empty host and path, no rule and the verdict
of a page without words; repeated rows are judged each; null texts have no words; an empty table
gives an empty result; columns beside id, url and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, even_lookup, table

#: (verdict, rule), fixed by the contract of the query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Words of unwanted hosts that mark training examples, one or two a topic.
SEEDS = ("ads", "bets", "casino", "escort", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
#: Letters of a host label (RFC 1035).
LABEL = 63
_LETTERS = r"\p{L}+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one; the first of equal lengths."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(reversed(rules), key=lambda x: len(x[1])):  # the longest is asked last and so decides
        h, p = r.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, F.lit(r)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def segment(piece: str, known: Mapping[str, int], total: int) -> list[str]:
    """The words of the cheapest split: a known word costs -ln of its share, an unknown one more than
    the rarest known and more with each letter. Of equal costs the one with the longer last words."""
    unknown = math.log(max(total, 1)) + 1.0
    best, back = [0.0], [0]
    for end in range(1, len(piece) + 1):
        options = []
        for start in range(end):
            n = known.get(piece[start:end])
            options.append((best[start] + (unknown + math.log(10) * (end - start) if n is None else math.log(total / n)), start))
        c, s = min(options)
        best.append(c)
        back.append(s)
    out, end = [], len(piece)
    while end:
        out.append(piece[back[end] : end])
        end = back[end]
    return out[::-1]


def pieces(host: Column) -> Column:
    return F.filter(F.split(host, r"[.-]"), lambda x: x != "")


def page_words(text: Column) -> Column:
    """The words of a page's text, without scripts, styles, tags and entities."""
    bare = F.regexp_replace(F.lower(text), r"(?s)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>|&#?\w+;", " ")
    return F.regexp_extract_all(bare, F.lit(_LETTERS), 0)


def path_words(path: Column) -> Column:
    """The words of a path, and # if it has digits."""
    low = F.lower(path)
    digits = F.when(low.rlike("[0-9]"), F.array(F.lit("#"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(low, F.lit(_LETTERS), 0), digits)


def unigrams(urls: DataFrame, texts: DataFrame | None, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(w, n) over all pages, from ``urls`` (host, path) and ``texts`` (text); seeds count one more."""
    spark = urls.sparkSession
    labels = urls.select("host").distinct().select(F.explode(F.split("host", r"\.")).alias("label")).distinct()
    apart = labels.where(F.size(pieces(F.col("label"))) > 1).select(F.explode(pieces(F.col("label"))).alias("w"))
    w = apart.unionByName(urls.select(F.explode(F.regexp_extract_all(F.lower("path"), F.lit(_LETTERS), 0)).alias("w")))
    if texts is not None:
        w = w.unionByName(texts.select(F.explode(page_words(F.col("text"))).alias("w")))
    w = w.unionByName(spark.createDataFrame([(x,) for x in seeds], "w string"))
    # Single letters would take any name apart.
    return w.where(F.length("w").between(2, LABEL)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words) for each of the distinct ``hosts`` (host), with the unigrams ``words`` (w, n)."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of = cut(hosts.select("host", F.posexplode(pieces(F.col("host"))).alias("at", "piece")), "pieces")
    distinct = of.select("piece").distinct()
    size = F.length("piece")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.sequence(F.lit(2), size - i + 1), lambda k: F.substr("piece", i, k))))
    parts = distinct.where(size.between(2, LABEL)).select("piece", F.explode(F.array_distinct(spans)).alias("w"))
    found = even_lookup(cut(parts, "substrings"), words, "w").where("n is not null")
    # At most as many as a piece has substrings.
    mine = found.groupBy("piece").agg(F.collect_list(F.struct("w", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [segment(p, {x["w"]: x["n"] for x in k or ()}, total) if len(p) <= LABEL else [p] for p, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["piece", "words"])

    split = cut(distinct.join(mine, "piece", "left").select("piece", "known").mapInArrow(run, "piece string, words array<string>"), "split")
    placed = even_lookup(of, split, "piece").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("x"))
    return placed.select("host", F.flatten(F.transform("x", lambda x: x["words"])).alias("words"))


def log_odds(counts: DataFrame, pages: int, blocked: int) -> tuple[float, DataFrame]:
    """The prior and (w, odds), log odds of block, from (w, b, a): the word's uses on blocked and allowed pages."""
    kinds, b, a = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    shift = math.log((a + kinds) / (b + kinds)) if kinds else 0.0
    return math.log((blocked + 1) / (pages - blocked + 1)), counts.select("w", (F.log((F.col("b") + 1) / (F.col("a") + 1)) + shift).alias("odds"))


def judge(pages: DataFrame, id: str = "page_id", url: str = "url", text: str | None = "html", rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score (log odds of block) for every row."""
    host, path = url_parts(F.col("url"))
    p = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"))
    p = cut(p.select("page_id", F.struct(host.alias("host"), path.alias("path")).alias("k")), "urls")
    u = cut(p.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k.*", "n"), "distinct")
    w = cut(unigrams(u, None if text is None else pages.select(F.col(text).alias("text")), seeds), "unigrams")
    names = cut(host_words(u.select("host").distinct(), w), "names")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    none = F.array().cast("array<string>")
    of_host = F.coalesce("words", none)
    seeded = F.arrays_overlap(of_host, F.array(*[F.lit(x) for x in seeds]).cast("array<string>"))
    bad = F.coalesce(verdict == "block", seeded, F.lit(False)).cast("long")
    seen = even_lookup(u, names, "host").select("host", "path", "n", rule.alias("rule"), verdict.alias("verdict"), of_host.alias("words"), F.concat(of_host, path_words(F.col("path"))).alias("all"), bad.alias("bad"))
    seen = cut(seen, "seen")
    uses = cut(seen.select("host", "path", "n", "bad", F.explode("all").alias("w")), "uses")
    counts = cut(uses.groupBy("w").agg(F.sum(F.col("n") * F.col("bad")).alias("b"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("a")), "counts")
    n, blocked = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("bad")), F.lit(0))).first()
    prior, odds = log_odds(counts, n, blocked)
    sums = even_lookup(uses.select("host", "path", "w"), odds, "w").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    score = F.round(F.lit(prior) + F.coalesce("odds", F.lit(0.0)), 9)
    judged = seen.join(sums, ["host", "path"], "left").select(F.struct("host", "path").alias("k"), "rule", "verdict", "words", score.alias("score"))
    out = even_lookup(p, cut(judged, "judged"), "k")
    by_score = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", F.col("k.host").alias("host"), F.col("k.path").alias("path"), "rule", F.coalesce("verdict", by_score).alias("verdict"), "words", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES: dict[str, str] = {}
