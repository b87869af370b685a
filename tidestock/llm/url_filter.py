"""URL filters: rules on host and path, and for the rest naive Bayes over segmented words.

Rules are written host/path; one fits its host and all subdomains if the url's path starts with the
rule's path, and the longest fitting rule decides. For urls that no rule fits, names in host (but
for its last label) and path are split into words by a unigram Viterbi search, whose word counts
come from the text of all pages, and a multinomial naive Bayes scores the words. It is trained on
the urls that rules decide, each page counting once, plus a fixed list of telling words.

Work on words is done once per url shape (names in order, digits as #), names are segmented once
each; pages look their shape up at the end. All lookups are joins of stored tables.

Defined cases: a null url or one without :// has empty host and path, no rule, and is judged by the
class prior alone, like urls without names; a tie allows. Very long urls and words are handled whole.
Repeated rows and null ids are judged like others; an
empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches

#: Substrings of names up to so many letters are looked up one by one; longer words by their first letters.
LONGEST = 20
#: Pages that each fixed word counts for, and the smoothing of the word counts.
SEED_PAGES, SMOOTHING = 5, 1.0

# Words that tell without any rule.
SEEDS = {
    "block": "adult bet bets betting bingo bonus casino escort gambling jackpot lottery malware nude phishing pills poker porn sex "
    "slots spam torrent viagra warez xxx".split(),
    "allow": "academy archive article blog docs edu encyclopedia gov guide help history journal library manual news paper press "
    "research school science tutorial university wiki".split(),
}


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty without ://; A-Z of the host are lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def names(text: Column) -> Column:
    """Runs of letters, lower-cased, and # for each run of digits."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
    return F.transform(runs, lambda r: F.when(r.rlike(r"^\p{N}"), "#").otherwise(r))


def segment(name: str, found: list[tuple[int, int, int]], total: int) -> list[str]:
    """Likeliest split of a name into words.

    found: (start, length, count) of its substrings that are words of the text. A substring that is
    none costs as if its chance fell tenfold with every letter.
    """
    n, tenfold = len(name), math.log(10)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start, length, count in found:
        ending[start + length].append((start, math.log(count / total)))
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    # Where an unknown piece that ends here or later begins best: the start that is worth most so far.
    worth, begin = -math.inf, 0
    for end in range(1, n + 1):
        if best[end - 1] + (end - 1) * tenfold >= worth:
            worth, begin = best[end - 1] + (end - 1) * tenfold, end - 1
        unknown = worth + tenfold - math.log(total) - end * tenfold
        best[end], back[end] = max([(unknown, begin)] + [(best[start] + cost, start) for start, cost in ending[end]])
    words, end = [], n
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def word_counts(html: Column, pages: DataFrame) -> DataFrame:
    """(word, count) over the text of all pages."""
    text = F.lower(F.regexp_replace(html, r"<[^>]*>", " "))
    words = F.explode(F.regexp_extract_all(text, F.lit(r"\b\p{L}+\b"), F.lit(0)))
    return pages.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def segmented(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for distinct names, by the word counts."""
    total = max(1, counts.agg(F.sum("count")).first()[0] or 1)
    starts = found.where("name <> '#'").select("name", F.posexplode(F.split("name", "")).alias("start", "_")).where("start < length(name)")
    lengths = starts.select(
        "name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("start")))).alias("length")
    )
    looked_up = lengths.withColumn("word", F.substring("name", F.col("start") + 1, F.col("length"))).join(counts, "word")
    # Longer words: a place with the same first letters, and then the whole word.
    longer = counts.where(F.length("word") > LONGEST).withColumn("head", F.substring("word", 1, LONGEST))
    heads = starts.where(F.length("name") - F.col("start") > LONGEST)
    heads = heads.withColumn("head", F.substring("name", F.col("start") + 1, F.lit(LONGEST))).join(longer, "head")
    whole = heads.where(F.substring("name", F.col("start") + 1, F.length("word")) == F.col("word"))
    looked_up = looked_up.select("name", "start", "length", "count").unionByName(
        whole.select("name", "start", F.length("word").alias("length"), "count")
    )
    known = looked_up.groupBy("name").agg(F.collect_list(F.struct("start", "length", "count")).alias("found"))  # words of one name

    def run(name, found):
        cut = [segment(x, [(r["start"], r["length"], r["count"]) for r in f or []], total) if x != "#" else ["#"] for x, f in zip(name, found)]
        return {"name": name, "words": cut}

    return map_batches(found.select("name").join(known, "name", "left"), run, "name string, words array<string>")


def naive_bayes(words: DataFrame) -> DataFrame:
    """(word, odds): log odds of block over allow, from (word, verdict, pages)."""
    one = [(w, v, SEED_PAGES) for v, seeds in SEEDS.items() for w in seeds]
    seeds = words.sparkSession.createDataFrame(one, "word string, verdict string, pages long")
    counts = words.unionByName(seeds).groupBy("word").agg(
        *[F.sum(F.when(F.col("verdict") == v, F.col("pages")).otherwise(0)).alias(v) for v in ("block", "allow")]
    )
    sums = counts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("size")).first()
    share = {v: (F.col(v) + SMOOTHING) / (sums[v] + SMOOTHING * sums["size"]) for v in ("block", "allow")}
    return counts.select("word", (F.log(share["block"]) - F.log(share["allow"])).alias("odds"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, odds); odds: log odds of block where the method decided."""
    scratch = Scratch(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    inner = F.regexp_extract("host", r"^(.*)\.[^.]*$", 1)
    shape = F.concat_ws(" ", names(inner), F.lit("/"), names(F.col("path")))
    rows = scratch.store(rows.select("page_id", "host", "path", "fit.rule", "fit.verdict", shape.alias("shape")), "pages")
    counts = scratch.store(word_counts(F.col("html"), pages), "counts")

    shapes = scratch.store(rows.groupBy("shape", "verdict").agg(F.count("*").alias("pages")), "shapes")
    parts = scratch.store(
        shapes.select("shape").distinct().select("shape", F.explode(F.split("shape", " ")).alias("name")).where("name not in ('', '/')"), "names"
    )
    cut = scratch.store(segmented(parts.select("name").distinct(), counts), "segmented")
    words = scratch.store(parts.join(cut, "name").select("shape", F.explode("words").alias("word")), "words")

    decided = shapes.where("verdict is not null")
    seen = words.join(decided, "shape").groupBy("word", "verdict").agg(F.sum("pages").alias("pages"))
    odds = scratch.store(naive_bayes(seen), "odds")
    sizes = {r["verdict"]: r["n"] for r in decided.groupBy("verdict").agg(F.sum("pages").alias("n")).collect()}
    prior = math.log((sizes.get("block", 0) + SMOOTHING) / (sizes.get("allow", 0) + SMOOTHING))
    scored = scratch.store(words.join(odds, "word").groupBy("shape").agg((F.sum("odds") + prior).alias("odds")), "scored")

    judged = rows.join(scored, "shape", "left").withColumn("odds", F.when(F.col("verdict").isNull(), F.coalesce("odds", F.lit(prior))))
    by_method = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), "odds")
