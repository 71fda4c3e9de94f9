"""URL filter: host and path rules first, then naive Bayes over the words that host and path names are made of.

Names are cut into words by the most likely path of a unigram model (Viterbi), whose counts are those of all words of
all page texts; a string it lacks costs more with each letter. A name meets only the words that are parts of it, by a join,
so the model is never held whole. Multinomial naive Bayes then scores the words of host and path; it learns from all URLs
that the rules decide, so it carries the rules' verdicts over to URLs no rule fits."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import discard, keyed_join, table, written

#: (verdict, host, path); a rule is written host + path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAGS = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|&[^;\s]{1,8};"


def host_of(url: Column) -> Column:
    """Lower-case (A-Z) text after the first :// up to /, ?, # or the end; without one or for null: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null; of rules of one length, the last by name."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits))


class Words:
    """Unigram model and Viterbi segmentation. counts: how often words occur; total: of all words, where counts has some only."""

    def __init__(self, counts: dict[str, int], total: int = 0):
        self.total = total or sum(counts.values()) or 1
        self.cost = {w: math.log(self.total / n) for w, n in counts.items() if w}
        self.longest = max(map(len, self.cost), default=1)

    def unknown(self, n: int) -> float:
        return math.log(self.total) + 2.5 * n

    def segment(self, name: str) -> list[str]:
        """The words of a name along its cheapest path; of equal ones, that with the longer last word. Letters no word covers
        stay together: a run of them costs one unknown word, whatever its length."""
        best, back, low = [0.0], [0], (math.inf, 0)
        for end in range(1, len(name) + 1):
            options = [(best[s] + self.cost[w], s) for s in range(max(0, end - self.longest), end) if (w := name[s:end]) in self.cost]
            low = min(low, (best[end - 1] - 2.5 * (end - 1), end - 1))  # where an unknown run to here starts best
            cost, start = min([*options, (low[0] + self.unknown(end), low[1])])
            best.append(cost)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]


def parts(host: str, path: str) -> list[tuple[str, str]]:
    """(h: or p:, name) of the runs of letters of host and path, in lower case; a run of digits has the name 0."""
    return [(kind, "0" if name[0].isdigit() else name) for kind, text in (("h:", host), ("p:", path.lower())) for name in re.findall(r"\d+|[^\W\d_]+", text)]


def _arrow(work, shape: pa.Schema):
    """A mapping of batches: work maps the columns of up to 2048 rows (lists) to an iterator of rows, told 10000 at once."""

    def run(batches):
        held = []

        def told():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                for row in work(*(c.to_pylist() for c in batch.slice(at, 2048).columns)):
                    held.append(row)
                    if len(held) >= 10_000:
                        yield told()
                        held = []
        if held:
            yield told()

    return run


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) of all runs of letters of all page texts, in lower case, without markup."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), _TAGS, " "))
    return pages.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) of each name, by the counts `words` (word, n). Each name is joined to the words that are parts of it."""
    total, longest = words.agg(F.sum("n"), F.max(F.length("word"))).first()
    total, longest = total or 0, longest or 1

    def substrings(batch):
        for name in batch:
            yield from ((name, name[s:e]) for s in range(len(name)) for e in range(s + 1, min(len(name), s + longest) + 1))

    def cut(batch, found):
        for name, counts in zip(batch, found):
            yield name, Words({c["word"]: c["n"] for c in counts or ()}, total).segment(name)

    text = pa.string()
    every = names.select("name").mapInArrow(_arrow(substrings, pa.schema([("name", text), ("word", text)])), "name string, word string")
    known = every.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    rows = names.select("name").join(known, "name", "left")
    return rows.mapInArrow(_arrow(cut, pa.schema([("name", text), ("words", pa.list_(text))])), "name string, words array<string>")


def weights(tokens: DataFrame) -> DataFrame:
    """(token, weight, n): log odds of block for each token of tokens (token, times, verdict or null), with add-one smoothing
    over the tokens of URLs with a verdict; the others' tokens are left out. n: rows of the token."""
    of = lambda kind: F.sum(F.when(F.col("verdict") == kind, F.col("times")).otherwise(0))
    seen = tokens.groupBy("token").agg(of("block").alias("block"), of("allow").alias("allow"), F.count("*").alias("n")).filter("block + allow > 0")
    total = seen.agg(F.sum("block").alias("blocks"), F.sum("allow").alias("allows"), F.count("*").alias("all"))
    odds = F.log((F.col("block") + 1) / (F.col("blocks") + F.col("all") + 1)) - F.log((F.col("allow") + 1) / (F.col("allows") + F.col("all") + 1))
    return seen.crossJoin(F.broadcast(total)).select("token", odds.alias("weight"), "n")  # one row


def prior(places: DataFrame) -> float:
    """Log odds of block among the URLs that rules decide. places: verdict or null, n."""
    n = {r["verdict"]: r["n"] for r in places.filter("verdict is not null").groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    return math.log((n.get("block", 0) + 1) / (n.get("allow", 0) + 1))


def judged(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of pages; score is the log odds of block, rounded to 9 places.

    Null URLs and those without :// have an empty host and path, which the prior decides. A tie (log odds 0) allows. A name
    of any length is cut whole. Null and empty pages give no words; without any word, names are tokens as they are.
    Repeated rows are judged alike, and each counts. Only the three named columns are read, so others may have any name.
    Empty pages: no rows."""
    split = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    split = written(split.withColumn("_rule", ruled(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "_rule.rule", "_rule.verdict"), "urls")
    places = written(split.groupBy("host", "path").agg(F.first("verdict").alias("verdict"), F.count("*").alias("n")), "places")

    def listed(hosts, paths, verdicts, ns):
        for host, path, verdict, n in zip(hosts, paths, verdicts, ns):
            for kind, name in parts(host, path):
                yield host, path, verdict, n, kind, name

    text = pa.string()
    shape = pa.schema([("host", text), ("path", text), ("verdict", text), ("times", pa.int64()), ("kind", text), ("name", text)])
    pieces = written(places.mapInArrow(_arrow(listed, shape), "host string, path string, verdict string, times long, kind string, name string"), "pieces")
    names = written(pieces.groupBy("name").agg(F.count("*").alias("n")), "names")
    cut = segmented(names.filter("name <> '0'"), written(word_counts(pages, html), "words"))
    cut = written(names.join(cut, "name", "left").select("name", "n", F.coalesce("words", F.array("name")).alias("words")), "segments")
    spread = keyed_join(pieces, cut, ["name"], pieces.count(), "path")
    tokens = written(spread.select("host", "path", "verdict", "times", F.explode("words").alias("word"), "kind").select("host", "path", "verdict", "times", F.concat("kind", "word").alias("token")), "tokens")
    odds = written(weights(tokens), "weights")
    sums = keyed_join(tokens, odds, ["token"], tokens.count(), "path").groupBy("host", "path").agg(F.sum("weight").alias("sum"))
    scores = written(places.select("host", "path", "n").join(sums, ["host", "path"], "left"), "scores")
    for one in (pieces, names, cut, tokens, odds):
        discard(one)
    score = F.round(F.coalesce("sum", F.lit(0.0)) + prior(places), 9)
    found = keyed_join(split, scores, ["host", "path"], split.count(), "page_id").withColumn("score", score)
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
