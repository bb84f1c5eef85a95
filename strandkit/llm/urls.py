"""URL filters: rules by host and path, and a character language-model ratio where no rule fits.

Two variable-order Markov models over characters, one of accepted and one of rejected URLs, with interpolated Witten-Bell
smoothing from order ORDER down to a uniform distribution. A URL is blocked when the difference of log-likelihoods a character
passes a threshold. The models count every example; the threshold is set on every example too, each scored by models of the folds it is
not in. Examples are labelled URLs of the caller's, or generated ones: ordinary pages on one side; gambling, adult, counterfeit,
tracking, download, account and machine-made addresses on the other. They know nothing of the rules, which decide before the models do.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_sum
from ..plans.seq import Seq
from .common import cut, tidied

ORDER, ALPHABET = 5, 256
#: Examples of each verdict that are generated.
PER_CLASS = 1500
#: Parts of the examples, by checksum.
FOLDS = 5
#: The caller's examples are counted on the driver up to so many characters in all, in tables beyond.
DRIVER_CHARS = 200_000
#: A gram that more rows than this hold is joined by broadcast.
OFTEN = 20_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the standard query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. A rule fits its host and all subdomains."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pair = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, pair) if out is None else out.when(fits, pair)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


class Markov:
    """Counts of the characters after every context of up to ORDER characters."""

    def __init__(self, texts: list[str]):
        seen: Counter[str] = Counter()
        for t in texts:
            s = "\x02" * ORDER + t + "\x03"
            for k in range(ORDER + 1):
                seen.update([s[i - k : i + 1] for i in range(ORDER, len(s))])
        self.count: dict[str, dict[str, int]] = defaultdict(dict)
        for g, n in seen.items():
            self.count[g[:-1]][g[-1]] = n
        self.count = dict(self.count)
        self.total = {c: sum(v.values()) for c, v in self.count.items()}

    def log_likelihood(self, text: str) -> float:
        """Per character."""
        s = "\x02" * ORDER + text + "\x03"
        out = 0.0
        for i in range(ORDER, len(s)):
            p = 1.0 / ALPHABET
            for k in range(ORDER + 1):
                seen = self.count.get(s[i - k : i])
                if seen is None:
                    break
                n, kinds = self.total[s[i - k : i]], len(seen)
                p = (seen.get(s[i], 0) + kinds * p) / (n + kinds)
            out += math.log(p)
        return out / (len(text) + 1)


def body(url: str | None) -> str:
    """What the models see: the URL without its scheme, digits made alike, lower case."""
    u = (url or "").lower()
    return re.sub(r"\d", "0", u.split("://", 1)[-1])


@dataclass
class Model:
    accepted: Markov
    rejected: Markov
    threshold: float

    def difference(self, url: str | None) -> float:
        return self.of_body(body(url))

    def of_body(self, t: str) -> float:
        return self.rejected.log_likelihood(t) - self.accepted.log_likelihood(t)


def train(samples: list[tuple[str, int]]) -> Model | None:
    """samples: (url, 1 if rejected). The models count all of them; the threshold is where balanced error is least over all of them,
    each scored by models of the other folds. It stays 0 where the examples of a verdict are all in one fold."""
    part = [(body(u), y, zlib.crc32(u.encode("utf-8", "surrogatepass")) % FOLDS) for u, y in samples]
    folds = [{f for _, y, f in part if y == c} for c in (0, 1)]
    if not all(folds):
        return None

    def fitted(but: int | None = None) -> Model:
        return Model(*(Markov([t for t, y, f in part if y == c and f != but]) for c in (0, 1)), 0.0)

    model = fitted()
    if min(map(len, folds)) > 1:
        scored = []
        for fold in folds[0] | folds[1]:
            others = fitted(fold)
            scored += [(others.of_body(t), y) for t, y, f in part if f == fold]
        model.threshold = threshold(*map(np.array, zip(*scored)))
    return model


def threshold(x: np.ndarray, y: np.ndarray) -> float:
    """The difference, or 0, at which balanced error is least; of equal ones the nearest to 0."""
    order = np.argsort(x)
    steps = np.where(y == 1, (y == 0).sum(), -(y == 1).sum())  # what a cut at or above x adds to the error, times both counts
    cuts = np.unique(np.append(x, 0.0))
    error = np.append(0, np.cumsum(steps[order]))[np.searchsorted(x[order], cuts, side="right")]
    return float(min(cuts[error == error.min()], key=lambda c: (abs(c), c)))


def grams(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, gram (ORDER characters and the next one of the body of `url`) and n, how often; counted a batch at a time, so
    a gram may have several rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted(c: Counter) -> pd.DataFrame:
            return pd.DataFrame([(*k, n) for k, n in c.items()], columns=[*keep, "gram", "n"])

        for f in frames:
            c: Counter = Counter()
            for url, *of in zip(f["url"], *(f[k] for k in keep)):
                t = "\x02" * ORDER + body(url) + "\x03"
                for a in range(ORDER, len(t), 100_000):
                    c.update((*of, t[i - ORDER : i + 1]) for i in range(a, min(a + 100_000, len(t))))
                    if len(c) > 100_000:
                        yield counted(c)
                        c.clear()
            yield counted(c)

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select("url", *keep).mapInPandas(tidied(run), f"{kinds}, gram string, n bigint")


def probabilities(seen: DataFrame, asked: DataFrame) -> DataFrame:
    """For each (v, gram) of `asked`, p0 and p1: how likely the last character is after the others by the accepted and the rejected URLs of
    model v. `seen` counts the grams of each model in c0 and c1. The definition is Markov's, one order after the other; every order
    meets its distinct grams only, so no key has more rows than there are characters."""
    p = None
    for k in range(ORDER + 1):
        tail = F.substring("gram", ORDER - k + 1, k + 1).alias("g")
        pairs = seen.groupBy("v", tail).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        after = pairs.groupBy("v", F.substring("g", 1, k).alias("context")).agg(
            *(F.sum(f"c{y}").alias(f"n{y}") for y in (0, 1)), *(F.count_if(F.col(f"c{y}") > 0).alias(f"kinds{y}") for y in (0, 1))
        )
        rows = asked.select("v", tail).distinct().join(pairs, ["v", "g"], "left")
        rows = rows.withColumn("context", F.substring("g", 1, k)).join(after, ["v", "context"], "left")
        if p is None:
            rows = rows.withColumns({"low0": F.lit(1.0 / ALPHABET), "low1": F.lit(1.0 / ALPHABET)})
        else:
            rows = rows.withColumn("shorter", F.substring("g", 2, k)).join(p.select("v", F.col("g").alias("shorter"), F.col("p0").alias("low0"), F.col("p1").alias("low1")), ["v", "shorter"])

        def one(y: int) -> Column:
            n, kinds, low = F.col(f"n{y}"), F.col(f"kinds{y}"), F.col(f"low{y}")
            return F.when(n > 0, (F.coalesce(f"c{y}", F.lit(0)) + kinds * low) / (n + kinds)).otherwise(low).alias(f"p{y}")

        p = rows.select("v", "g", one(0), one(1))
    return p.withColumnRenamed("g", "gram")


def scored(rows: DataFrame, seen: DataFrame, often: int = OFTEN) -> DataFrame:
    """The rows (url, v and others) with `difference` by model v."""
    rows = cut(rows.withColumn("id", F.monotonically_increasing_id()))
    held = cut(grams(rows, "id", "v"))
    asked = held.groupBy("v", "gram").agg(F.count("*").alias("uses"))
    p = cut(probabilities(seen, asked).join(asked, ["v", "gram"]).select("v", "gram", "uses", (F.log("p1") - F.log("p0")).alias("ratio")))
    hot = p.where(F.col("uses") > often).drop("uses")
    found = held.join(F.broadcast(hot), ["v", "gram"]).unionByName(
        held.join(F.broadcast(hot.drop("ratio")), ["v", "gram"], "left_anti").join(p.where(F.col("uses") <= often).drop("uses"), ["v", "gram"])
    )
    # decimals add up to the same in any order
    sums = found.groupBy("id").agg((F.sum((F.col("n") * F.col("ratio")).cast("decimal(28,18)")).cast("double") / F.sum("n")).alias("difference"))
    return cut(rows.join(sums, "id").drop("id"))


def judged_by_tables(urls: DataFrame, examples: DataFrame, often: int = OFTEN) -> tuple[DataFrame, float] | None:
    """(url, difference) of every row of `urls`, distinct and not null, and the threshold, as `train` on all of `examples` (distinct url,
    rejected) has them; None if a verdict has no example. Counts, models and scores stay in tables, whatever their number."""
    fold = (F.crc32(F.col("url").cast("binary")) % FOLDS).cast("int")
    one = cut(examples.select("url", F.col("rejected").alias("y"), fold.alias("fold")))
    n = {r["y"]: r for r in one.groupBy("y").agg(F.count("*").alias("n"), F.countDistinct("fold").alias("folds")).collect()}
    if len(n) < 2:
        return None
    counted = grams(one, "y", "fold").groupBy("y", "fold", "gram").agg(F.sum("n").alias("n"))
    # model 0 counts all folds, model v all but fold v - 1
    each = counted.withColumn("v", F.explode(F.array(*map(F.lit, range(FOLDS + 1))))).where(F.col("v") != F.col("fold") + 1)
    sums = [F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)).alias(f"c{y}") for y in (0, 1)]
    seen = cut(each.groupBy("v", "gram").agg(*sums))
    limit = 0.0
    if min(r["folds"] for r in n.values()) > 1:
        step = F.when(F.col("y") == 1, F.lit(n[0]["n"])).otherwise(F.lit(-n[1]["n"]))
        steps = scored(one.select("url", "y", (F.col("fold") + 1).alias("v")), seen, often).select("difference", step.cast("bigint").alias("step"))
        zero = urls.sparkSession.range(1).select(F.lit(0.0).alias("difference"), F.lit(0).cast("bigint").alias("step"))
        cuts = cut(steps.unionByName(zero).groupBy("difference").agg(F.sum("step").alias("step")))
        errors = running_sum("error", F.col("step"))(Seq(cuts, ("difference",))).df
        limit = errors.orderBy("error", F.abs("difference"), "difference").first()["difference"]
    return scored(urls.select("url", F.lit(0).alias("v")), seen, often).select("url", "difference"), limit


class Examples:
    """Generated labelled URLs; everything comes from the seed."""

    #: Fixed words, of addresses that are kept and of such as are not.
    TOPICS = "news article articles blog post posts story stories wiki docs guide guides help about research paper papers review reviews recipe recipes travel science history culture sport sports politics health garden music library archive".split()
    SYLLABLES = "the ing er on an re tion th en ou la de mar sol ber lin ka to mi ne ro sa vi el ra ti no lu che ge ein ver ung que mente cion ado al is ha wi st or le".split()
    LURES = "casino bonus poker slots jackpot betting lottery viagra cialis pills pharmacy cheap discount replica loan loans payday crypto airdrop xxx porn sex cam cams nude escort dating torrent crack keygen warez serial hack cheats winner prize free click followers".split()
    ADS = "ads ad track tracker tracking pixel click clicks banner affiliate redirect doubleclick popunder counter beacon".split()
    PAGES = "login signin logout register cart checkout wp-admin wp-login.php admin account session cgi-bin xmlrpc.php phpmyadmin password-reset unsubscribe".split()
    FILES = "setup.exe installer.exe movie.mkv.torrent full-version.rar crack.zip apk-mod.apk patch.msi".split()

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def n(self, a: int, b: int) -> int:
        return int(self.r.integers(a, b))

    def one(self, *xs: str) -> str:
        return xs[self.n(0, len(xs))]

    def of(self, alphabet: str, n: int) -> str:
        return "".join(self.r.choice(list(alphabet), n))

    def word(self) -> str:
        return "".join(self.one(*self.SYLLABLES) for _ in range(self.n(2, 4)))

    def scheme(self) -> str:
        return self.one("http://", "https://", "https://")

    def accepted(self) -> str:
        name = self.word() + (self.one(".", "-") + self.word() if self.n(0, 3) == 0 else "")
        host = self.one("", "", "www.", "blog.", "m.", "en.", "de.", "news.") + name + self.one(".com", ".org", ".net", ".edu", ".de", ".fr", ".es", ".co.uk", ".info")
        lang = self.one("", "", "/en", "/de", "/fr", "/es", "/it")
        slug = "-".join(self.word() for _ in range(self.n(1, 6)))
        date = f"/20{self.n(0, 3)}{self.n(0, 10)}/{self.n(1, 13):02d}"
        path = self.one(f"/{self.n(1, 99999)}", f"/{self.one(*self.TOPICS)}/{slug}", f"/{self.one(*self.TOPICS)}/{self.n(1, 99999)}", f"{date}/{slug}", f"/{slug}", "/")
        return self.scheme() + host + lang + path + self.one("", "", "", ".html", "/", "?page=2", "?page=3&ref=x", "#top", "?utm_source=feed", f"#{self.word()}")

    def rejected(self) -> str:
        low, hexa = "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
        lure = "-".join(self.one(*self.LURES) for _ in range(self.n(1, 4)))
        own = self.word() + self.one(".com", ".org", ".net", ".info", ".biz", ".de")
        end = self.one(".com", ".net", ".org", ".biz", ".xyz", ".top", ".click", ".loan", ".info")
        kind = self.n(0, 8)
        if kind == 0:
            return self.scheme() + self.one("", "www.") + lure + self.one("", "24", "365", "-online", self.of("0123456789", 3)) + end + self.one("/", "/play", f"/{self.one(*self.LURES)}", "/?aff=" + self.of(low, 6))
        if kind == 1:
            return self.scheme() + self.one("", "www.", "m.") + own + f"/{self.one(*self.LURES)}/{lure}" + self.one("", ".html", f"-{self.n(1, 999)}", "?id=" + self.of("0123456789", 6))
        if kind == 2:
            return self.scheme() + self.one(*self.ADS) + self.one("", str(self.n(1, 20))) + "." + own + f"/{self.one(*self.ADS)}?{self.one('id', 'cid', 'aff', 'zone')}={self.of(hexa, self.n(8, 25))}&{self.one('url', 'r', 'to')}=http%3A%2F%2F{self.word()}.com"
        if kind == 3:
            return self.scheme() + self.of(low, self.n(10, 25)) + end + "/" + self.of(low, self.n(4, 14))
        if kind == 4:
            return self.scheme() + own + f"/{self.one(*self.PAGES)}" + self.one("", f"?sid={self.of(hexa, 32)}", f"?return={self.word()}", f"?PHPSESSID={self.of(hexa, 26)}")
        if kind == 5:
            return self.scheme() + own + f"/{self.one('download', 'dl', 'get', 'files')}/{lure}/{self.one(*self.FILES)}"
        if kind == 6:
            return self.scheme() + own + "/" + self.one("index.php", "search", "calendar", "list") + "?" + "&".join(f"{self.one('sort', 'filter', 'sid', 'token', 'cat', 'view', 'q', 'month')}={self.of(hexa, self.n(4, 18))}" for _ in range(self.n(3, 7)))
        return self.scheme() + self.one(f"{self.n(1, 256)}.{self.n(0, 256)}.{self.n(0, 256)}.{self.n(1, 255)}", own + ":8080") + "/" + self.one(lure, self.of(low, 12), self.one(*self.FILES))

    def rows(self, n: int) -> list[tuple[str, int]]:
        """n URLs of each kind, accepted (0) and rejected (1) in turn."""
        return [(self.rejected() if i % 2 else self.accepted(), i % 2) for i in range(2 * n)]


def verdicts(model: Model | None):
    """difference (positive: nearer to the rejected) and verdict; without a model everything is allowed."""

    @F.pandas_udf("difference double, verdict string")
    @tidied
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            d = [model.difference(u) if model and u else 0.0 for u in urls]
            bad = [bool(model and u) and x > model.threshold for u, x in zip(urls, d)]
            yield pd.DataFrame({"difference": d, "verdict": ["block" if b else "allow" for b in bad]})

    return apply


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, examples: DataFrame | None = None, per_class: int = PER_CLASS, driver_chars: int = DRIVER_CHARS
) -> DataFrame:
    """page_id, host, path, rule, verdict, difference for every row.

    The longest fitting rule decides, of equally long ones the first by its text; else the models. They learn from all distinct URLs of
    `examples` (url, rejected 0/1; of several labels the largest holds), or by default from `per_class` generated ones of each verdict.
    Examples of more than `driver_chars` characters in all are counted, and the pages scored, in tables; the results are the same.
    Null URLs and URLs without :// have an empty host and path, fit no rule and, if null or empty, are allowed. Repeated rows are
    judged alike, whole URLs of any length are read, other columns are ignored, and an empty table gives an empty result.
    """
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    model = None
    if examples is None:
        model = train(sorted(Examples(5).rows(per_class)))
    else:
        one = examples.where(F.col("url").isNotNull() & F.col("rejected").isin(0, 1)).groupBy("url").agg(F.max(F.col("rejected").cast("int")).alias("rejected"))
        if (one.agg(F.sum(F.length("url") + 1)).first()[0] or 0) <= driver_chars:
            model = train(sorted((r["url"], r["rejected"]) for r in one.collect()))
        elif by_tables := judged_by_tables(base.where(F.col("url") != "").select("url").distinct(), one):
            differences, limit = by_tables
            verdict = F.when(F.col("difference") > limit, "block").otherwise("allow").alias("verdict")
            m = F.struct(F.coalesce("difference", F.lit(0.0)).alias("difference"), verdict)
            return _rows(base.join(differences, "url", "left").withColumn("m", m))
    return _rows(base.withColumn("m", verdicts(model)("url")))


def _rows(judged: DataFrame) -> DataFrame:
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.col("m.verdict")).alias("verdict"),
        F.col("m.difference").alias("difference"),
    )
