"""URL filters: rules by host and path, else a classifier over segmented words.

Labels that concatenate words are split by a unigram model and Viterbi; the
words of host and path are scored by multinomial naive Bayes. The unigram counts are
those of all rows' hosts and paths, each word once for each host. Naive Bayes starts from the
listed examples (fixed values below) and learns from every row that a rule decides,
each word once for each host and verdict; what the rules themselves read (the
host's ending, the path's first folders, words that they name) is no evidence there. Names that few
hosts use are not learnt. `held_out` measures it on hosts left out.

A label that only one host has is split where its letters allow it. A word that holds a listed word counts as a word of its own from MIN_HOSTS hosts on,
unless it is made of listed words only: then its split decides.

Scale: all in exchanges; the driver gets sums only and no vocabulary is broadcast.
Distinct labels are cut into their substrings, which look up their costs by a join, so
a label is split with just the words that occur in it. Scores come back to the
URLs by their labels; other columns aren't read for it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_mod, dropped, prepare, stored

#: Letters of a counted word at least and at most (a host's label has no more); hosts from which a word is learnt.
MIN_WORD, MAX_WORD, MIN_HOSTS = 2, 63, 5
#: Letters of a label that are cut into substrings at once, and substrings in a batch.
PIECE, BATCH = 4096, 50_000
#: Costs in a split: of a listed word at most, of an unknown letter, of an unknown part of a label. They don't depend on the table's size.
LISTED, LETTER, PART = 6.0, 2.5, 4.0
#: Log odds of a blocked URL without any evidence. The rules' own share says nothing about other URLs.
PRIOR = math.log(1 / 3)

# Examples of host and path words for each class, and rules.
BLOCKED_EXAMPLES = """
casino win | casino bonus | online casino | free bets | sports betting | bet now | poker online | slots jackpot | roulette spin | lottery winner
adult x | adult video | xxx videos | porn tube | sex cams | live sex | hot girls | escort service | nude photos | erotic chat
spam farm | link farm | cheap pills | viagra pills | buy viagra | cialis online | weight loss pills | payday loans | quick loans | easy money
free money | get rich | click here | free iphone | free prize | win prize | crack download | warez torrent | keygen serial | fake watches
ads track | ad server | ad click | tracking pixel | banner ads | popup ads | click track | ads network | track clicks | spam mail
replica watches | malware download | phishing login | hack account | buy followers | cheap followers | gamble online | bets win | adult dating | xxx dating
"""
ALLOWED_EXAMPLES = """
news today | daily news | science journal | health guide | open library | travel blog | city council | history museum | cooking recipes | garden tips
music review | book review | school district | university press | research lab | weather report | sports club | local paper | tech notes | code docs
photo gallery | art gallery | public radio | film festival | language course | maths lessons | nature park | community forum | family doctor | home page
about us | contact page | terms privacy | help center | user guide | product manual | blog post | article archive | events calendar | site map
race track | track record | bed linen | walking club | science fair | travel map
"""
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def parts_of_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null without one. A rule fits its host and all its subdomains if the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def cheapest_split(label: str, cost: dict[str, float]) -> list[str]:
    """The cheapest split into words and unknown parts, by Viterbi over its places, in time linear in its length. A label without a cheaper split stays whole."""
    lengths = sorted({len(w) for w in cost})
    # cost and start of the last word, or of the last unknown part, that ends at a place
    words, parts = [(0.0, 0)], [(math.inf, 0)]
    for end in range(1, len(label) + 1):
        known = [(min(words[end - n][0], parts[end - n][0]) + cost[label[end - n : end]], end - n) for n in lengths if n <= end and label[end - n : end] in cost]
        words.append(min(known, default=(math.inf, 0)))
        parts.append(min((parts[-1][0] + LETTER, parts[-1][1]), (words[end - 1][0] + PART + LETTER, end - 1)))
    out, end, unknown = [], len(label), parts[-1][0] < words[-1][0]
    if min(words[-1][0], parts[-1][0]) >= LETTER * len(label) and label not in cost:
        return [label]
    while end:
        start = (parts if unknown else words)[end][1]
        out.append(label[start:end])
        end, unknown = start, not unknown and parts[start][0] < words[start][0]
    return out[::-1]


def examples(text: str) -> list[list[str]]:
    return [x.split() for line in text.strip().splitlines() for x in line.split("|")]


def readable(host: Column, path: Column) -> Column:
    """Host and path in lower case, percent-encoded characters of the path read where all of them are valid UTF-8."""
    return F.lower(F.concat_ws(" ", host, F.coalesce(F.try_url_decode(path), path)))


def labels_of(host: Column, path: Column) -> Column:
    """Runs of letters of any script."""
    return F.regexp_extract_all(readable(host, path), F.lit(r"(\p{L}+)"), F.lit(1))


def unruled_labels(host: Column, path: Column, rules=RULES) -> Column:
    """Labels of what no rule reads: of the host before a rule's host and of the path after as many folders as the deepest rule has, without the words that rules name."""
    ends = "|".join(re.escape(h) for h in sorted({h for _, h, _ in rules}))
    host = F.regexp_replace(host, rf"(?:^|\.)(?:{ends})$", "") if ends else host
    depth = max((len([x for x in p.split("/") if x]) for *_, p in rules), default=0)
    named = sorted({w for _, h, p in rules for w in re.findall(r"[^\W\d_]+", (h + p).lower())})
    labels = labels_of(host, F.regexp_replace(path, rf"^(?:/[^/]*){{0,{depth}}}", ""))
    return F.filter(labels, lambda w: ~w.isin(*named)) if named else labels


def judged(pages: DataFrame, names: list[str], url_col: str, rules) -> DataFrame:
    host, path = parts_of_url(F.col(url_col))
    x = pages.select(*names, host.alias("host"), path.alias("path"))
    return x.withColumn("__rule", matched_rule(F.col("host"), F.col("path"), rules))


def count_labels(urls: DataFrame, rules=RULES, learn: Column | None = None) -> DataFrame:
    """(w, n, block, allow) of the labels of urls (host, path, verdict): the hosts that have one, and those that have it where a rule blocks or allows (and learn holds)."""
    path = F.col("path")
    decided = F.col("verdict").isNotNull() & (F.lit(True) if learn is None else learn)
    free = F.when(decided, unruled_labels(F.col("host"), path, rules)).otherwise(F.array().cast("array<string>"))
    pair = lambda v: lambda w: F.struct(w.alias("w"), v.alias("v"))
    both = F.concat(F.transform(F.array_distinct(labels_of(F.col("host"), path)), pair(F.lit(None).cast("string"))), F.transform(F.array_distinct(free), pair(F.col("verdict"))))
    seen = urls.select("host", F.explode(both).alias("x")).select("host", "x.w", "x.v").distinct()
    return seen.groupBy("w").agg(F.count_if(F.col("v").isNull()).alias("n"), F.count_if(F.col("v") == "block").alias("block"), F.count_if(F.col("v") == "allow").alias("allow"))


def listed_words() -> list[str]:
    return sorted({w for x in examples(BLOCKED_EXAMPLES) + examples(ALLOWED_EXAMPLES) for w in x})


def word_costs(counts: DataFrame) -> DataFrame:
    """(w, cost) of counted and listed words, by their share of the counts; half of the weight is the listed words'."""
    listed = listed_words()
    some = "|".join(w for w in listed if len(w) > 2)
    w, n = F.col("w"), F.col("n")
    own = ~w.rlike(some) | w.isin(*listed) | ((n >= MIN_HOSTS) & ~w.rlike(f"^(?:{some})+$"))
    counted = counts.where(F.when(F.length(w).between(MIN_WORD, MAX_WORD), own).otherwise(F.lit(False))).select("w", "n")
    total = counted.agg(F.sum("n")).first()[0] or 1
    fixed = counts.sparkSession.range(1).select(F.explode(F.array(*(F.lit(x) for x in listed))).alias("w"), F.lit(0).cast("long").alias("n"))
    cost = F.when(n > 0, F.log(2 * total / n))
    return counted.unionByName(fixed).groupBy("w").agg(F.max("n").alias("n")).select("w", F.when(w.isin(*listed), F.least(F.lit(LISTED), cost)).otherwise(cost).alias("cost"))


def _substrings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, sub) of all substrings up to MAX_WORD letters, repeated ones once for each piece of a label."""
    keys, subs = [], []
    for batch in batches:
        for key, w in zip(batch["key"], batch["w"], strict=True):
            for at in range(0, len(w), PIECE):
                met = {w[i : i + k] for i in range(at, min(at + PIECE, len(w))) for k in range(1, min(MAX_WORD, len(w) - i) + 1)}
                keys += [key] * len(met)
                subs += met
                if len(subs) >= BATCH:
                    yield pd.DataFrame({"key": keys, "sub": subs})
                    keys, subs = [], []
    if subs:
        yield pd.DataFrame({"key": keys, "sub": subs})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(labels: pd.Series, own: pd.Series, words: pd.Series, costs: pd.Series) -> pd.Series:
    out = []
    for w, whole, k, c in zip(labels, own, words, costs, strict=True):
        cost = {} if k is None else dict(zip(k, c, strict=True))
        if not whole:
            cost.pop(w, None)
        out.append(cheapest_split(w, cost))
    return pd.Series(out, dtype=object)


def split_labels(labels: DataFrame, costs: DataFrame) -> DataFrame:
    """labels (w, n, ...) with the words of each w, from the costs of just the words that occur in it. That one host has a label doesn't make it a word in its own split."""
    own = (F.col("n") > 1) | F.col("w").isin(*listed_words())
    keyed = labels.withColumn("key", F.when(F.length("w") <= MAX_WORD, F.col("w")).otherwise(F.sha2("w", 256)))
    cut = keyed.select("key", "w").mapInPandas(_substrings, "key string, sub string")
    found = cut.join(costs.withColumnRenamed("w", "sub"), "sub").groupBy("key").agg(F.collect_set(F.struct("sub", "cost")).alias("found"))
    return keyed.join(found, "key", "left").select(*labels.columns, _split(F.col("w"), own, F.col("found.sub"), F.col("found.cost")).alias("words"))


def word_odds(spark: SparkSession, learnt: DataFrame | None = None, smooth: float = 0.2) -> DataFrame:
    """(w, odds): log odds of blocked against allowed for a word, from the examples and the learnt counts (w, block, allow), with smoothing."""
    b, a = (Counter(w for x in examples(t) for w in x) for t in (BLOCKED_EXAMPLES, ALLOWED_EXAMPLES))
    rows = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(b[w]).cast("long").alias("block"), F.lit(a[w]).cast("long").alias("allow")) for w in listed_words()))
    counts = spark.range(1).select(F.inline(rows))
    if learnt is not None:
        counts = counts.unionByName(learnt.select("w", "block", "allow"))
    counts = counts.groupBy("w").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).where((F.col("block") + F.col("allow") >= MIN_HOSTS) | F.col("w").isin(*listed_words()))
    counts = stored(counts, "classes")
    n, nb, na = counts.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    share = lambda c, total: F.log((F.col(c) + smooth) / (total + smooth * n))
    return counts.select("w", (share("block", nb) - share("allow", na)).alias("odds"))


def label_odds(urls: DataFrame, rules=RULES, learn: Column | None = None) -> DataFrame:
    """(w, odds) of all labels of urls (host, path, verdict) that don't count nothing, as a stored table."""
    spark = urls.sparkSession
    counts = stored(count_labels(urls, rules, learn), "labels")
    costs = stored(word_costs(counts), "costs")
    split = stored(split_labels(counts, costs), "splits")
    word = F.explode("words").alias("word")
    learnt = split.where("block + allow > 0").select(F.explode(F.array_distinct("words")).alias("w"), "block", "allow").groupBy("w").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    odds = word_odds(spark, learnt)
    out = stored(split.select("w", word).join(odds.withColumnRenamed("w", "word"), "word").groupBy("w").agg(F.sum("odds").alias("odds")).where("odds != 0"), "odds")
    dropped(spark, counts, costs, split, odds)
    return out


def text_odds(texts: DataFrame, odds: DataFrame) -> DataFrame:
    """(key, odds) of texts (key, labels): the sum over all labels, repeats counted; keys without any known label are left out."""
    each = texts.select("key", F.explode("labels").alias("w")).groupBy("key", "w").agg(F.count("*").alias("n"))
    return each.join(odds, "w").groupBy("key").agg(F.sum(F.col("n") * F.col("odds")).alias("odds"))


def held_out(pages: DataFrame, url_col: str = "url", rules=RULES, parts: int = 5) -> DataFrame:
    """One row (n, block, right): how many distinct URLs that a rule decides are of hosts whose crc32 is a multiple of parts, how many of them a rule blocks, and
    for how many a model learnt from the other hosts says the same from what no rule reads."""
    prepare(pages.sparkSession)
    urls = judged(pages, [], url_col, rules).select("host", "path", F.col("__rule.verdict").alias("verdict")).distinct()
    out = crc_mod(F.col("host"), parts) == 0
    odds = label_odds(urls, rules, learn=~out)
    tests = urls.where(out & F.col("verdict").isNotNull()).withColumn("key", _key())
    scored = text_odds(tests.select("key", unruled_labels(F.col("host"), F.col("path"), rules).alias("labels")), odds)
    says = F.when(PRIOR + F.coalesce(F.col("odds"), F.lit(0.0)) > 0, "block").otherwise("allow")
    return tests.join(scored, "key", "left").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("block"), F.count_if(F.col("verdict") == says).alias("right"))


def _key() -> Column:
    return F.sha2(F.concat("host", F.lit("\0"), "path"), 256)


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """Each row with host, path, rule, verdict (block or allow) and score (log odds of blocked; null where a rule decides).

    A null URL, or one without ://, has empty host and path; no rule fits it and it
    has the prior's verdict, allow. Repeated rows are judged alike. Input columns
    named like an output are replaced. An empty table stays empty.
    """
    prepare(pages.sparkSession)
    outputs = ("host", "path", "rule", "verdict", "score")
    names = [c for c in pages.columns if c not in outputs]
    urls = judged(pages, [], url_col, rules).select("host", "path", F.col("__rule.verdict").alias("verdict")).distinct()
    odds = label_odds(urls, rules)
    scored = text_odds(urls.where("verdict is null").select(_key().alias("key"), labels_of(F.col("host"), F.col("path")).alias("labels")), odds)
    # every row has its URL's key, so that those that a rule decides aren't one key; sums in another order differ in their last digits
    x = judged(pages, names, url_col, rules).withColumn("__key", _key())
    x = x.join(scored.select(F.col("key").alias("__key"), F.round("odds", 9).alias("__odds")), "__key", "left")
    score = F.when(F.col("__rule").isNull(), PRIOR + F.coalesce(F.col("__odds"), F.lit(0.0)))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(score > 0, "block").otherwise("allow"))
    return x.select(*names, "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))
