"""Secret scans, with DataFrame functions only: a random forest over candidates, which removes the false positives.

A candidate is a run of key characters (letters, digits, + / _ -) of twelve or more with a digit in it, one that starts as a known
key does, whatever its digits, a private key block, or a value of eight or more after a word such as password, with or without a sign,
blanks and quotes. One pass of one pattern over a text finds them all. Features: length, shares and transitions of character classes,
distinct characters, coverage by a dictionary of common letter groups, known key forms, paths and URLs around it, and neighbouring
words. The forest learns from labelled findings, by default generated ones, on the driver, and runs as SQL conditions. No text leaves
its row.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

_C = "[A-Za-z0-9+/_-]"
_RUN = f"(?={_C}{{12}})[A-Za-z+/_-]*+[0-9]{_C}*+={{0,2}}"
#: How known keys start.
_PREFIX = "AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abps]-|sk_live_|sk-|rk_live_|AIza|eyJ|npm_|hf_"
_KNOWN = f"(?={_C}{{12}})(?:{_PREFIX}){_C}++={{0,2}}"
_BLOCK = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\\s\\\\]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
#: A word that announces a secret, with a part after it as in secret_key, passwordHash or tokens.
_KEYWORD = "(?:(?i:p(?:ass(?:w(?:or)?d|phrase)|wd|rivate[ _-]?key)|(?<![a-z])pass|secret|token|a(?:pi|ccess)[ _-]?key|credential|bearer|(?<![a-z])o?auth)(?:(?i:s)|(?i:[ _-]?key)|[_-][A-Za-z0-9_-]{1,12}|[A-Z][A-Za-z0-9]{1,12})?)"
_SIGN = "[\"']?(?:\\s{0,3}(?:[:=]{1,2}|=>)\\s{0,3}|\\s{1,3}(?i:is)\\s{1,3}|\\s{1,3})[\"']?"
_V = "[A-Za-z0-9+/_!@#$%^&*-]"
#: From where a run begins to the sign after its word; a value that itself is such a word with a sign is none.
_NAMED = f"{_C}*?{_KEYWORD}{_SIGN}"
_VALUE = f"(?<=[\\s=:>\"'])(?={_V}{{8}})(?!{_NAMED}{_V}){_V}++"
CANDIDATE = f"(?<!{_C})(?:({_NAMED})({_VALUE})|({_BLOCK}|{_KNOWN}|{_RUN}))"
#: Marks around candidates: private-use characters. One that the text holds itself is escaped, so nothing is lost.
_MARK, _CUT, _ESC = "\ue000", "\ue000\ue001", "\ue000\ue002"
#: Fixed letter groups of common words of English, German, French and Spanish.
DICTIONARY = "the and ing tion ent ation for ere her ter hat tha ate ver all ons est ith ment section page image user file data name test part item order der die und ein ich sch den ung che gen eau que les des ous ais eur pour dans una los las por con del ado ente aci able ness ight word line text article chapter version report table index".split()
_GROUPS = "(?:" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"
MASK = "[SECRET]"
#: Words of generated passwords, and words that follow a word such as password in plain prose.
WORDS = "correct horse battery staple summer winter dragon monkey hunter shadow silver orange purple river mountain coffee guitar planet rocket tiger welcome admin letme master secure falcon wizard pepper cookie island".split()
PLAIN = "required protected authentication management everything something agreement incorrect different generated manager-based validation forgotten available reset-link ingredient recovery economics necessary important published encryption parameter passwords sommerhaus immediately Everything Something Required".split()
NAMES = ["length", "digits", "uppers", "lowers", "marks", "transitions", "distinct", "dictionary", "hex", "known", "uuid", "date", "number", "slashes", "in_path", "extension", "assigned", "secret_word", "benign_word", "quoted", "repeats", "sign", "placeholder"]


def features(c: Column, left: Column, right: Column) -> Column:
    """An array of doubles, in the order of NAMES."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")

    def count(p: str) -> Column:
        return F.regexp_count(c, F.lit(p)) / n

    def flag(b: Column) -> Column:
        return F.coalesce(b, F.lit(False)).cast("double")

    wide = F.right(left, F.lit(60))
    tail, near, front = F.lower(F.substring(F.right(left, F.lit(60)), 1, 60)), F.lower(F.right(left, F.lit(28))), F.left(right, F.lit(12))
    return F.array(
        n,
        count("[0-9]"),
        count("[A-Z]"),
        count("[a-z]"),
        count("[^A-Za-z0-9]"),
        count("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
        F.size(F.array_distinct(F.split(c, ""))) / n,
        F.lit(1.0) - F.length(F.regexp_replace(F.lower(c), _GROUPS, "")) / n,
        flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        flag(c.rlike(f"^(?:{_PREFIX}|-----BEGIN)")),
        flag(c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
        flag(c.rlike("^[0-9]{4}[-/][0-9]{1,2}[-/]")),
        flag(c.rlike("^[0-9+/_-]+$")),
        count("/"),
        flag(near.rlike("(?:/|://|\\\\|www\\.)[^\\s]*$")),
        flag(front.rlike("^\\.[a-z]{2,4}")),
        flag(wide.rlike(f"{_KEYWORD}{_SIGN}$")),
        flag(tail.rlike("pass(?:word|wd)|secret|token|api[ _-]?key|credential|private key|bearer")),
        flag(near.rlike("(?:sha-?[0-9]*|md5|commit|checksum|digest|uuid|guid|isbn|doi|order|invoice|phone|tel|build|version|rev|etag|id|hash|ref|iban|card)[\"']?\\s*[=:#]?\\s*[\"']?$")),
        flag(F.right(left, F.lit(1)).isin('"', "'")),
        count("(.)\\1"),
        F.when(near.rlike("=>?\\s*[\"']?$"), 3.0).when(near.rlike(":\\s*[\"']?$"), 2.0).when(near.rlike("\\sis\\s+[\"']?$"), 1.0).otherwise(0.0),
        flag(c.rlike("example|change|your|placeholder|dummy|sample|undefined|required|x{4}|0{8}")),
    )


def candidates(text: Column) -> Column:
    """The text in turns of context and candidate: elements 1, 3, 5 … (from 0) are candidates. Null for null."""
    safe = F.replace(text, F.lit(_MARK), F.lit(_ESC))
    return F.split(F.regexp_replace(safe, CANDIDATE, f"$1{_CUT}$2$3{_CUT}"), _CUT)


def plain(piece: Column) -> Column:
    return F.replace(piece, F.lit(_ESC), F.lit(_MARK))


class Findings:
    """Generated labelled findings: (left, candidate, right, label). Everything comes from the seed."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def of(self, alphabet: str, n: int) -> str:
        return "".join(self.r.choice(list(alphabet), n))

    def one(self, *xs: str) -> str:
        return xs[int(self.r.integers(len(xs)))]

    def word(self) -> str:
        return "".join(self.one("th", "en", "er", "on", "re", "sch", "ou", "ing", "tion", "la", "que", "de", "an", "st", "ä", "é", "os") for _ in range(int(self.r.integers(1, 4))))

    def prose(self) -> str:
        return " ".join(self.word() for _ in range(int(self.r.integers(2, 9)))) + " "

    def secret(self) -> tuple[str, str, str]:
        up, low, dig, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
        every, n = up + low + dig, lambda a, b: int(self.r.integers(a, b))
        key = self.one("password", "passwd", "secret", "token", "api_key", "api-key", "access_key", "secret_key", "auth_token", "client_secret", "API_KEY", "pwd", "Token", "bearer", "passphrase", "DB_PASSWORD", "private_key", "secretKey", "credentials", "Password")
        sign, q = self.one("=", ": ", " = ", ":", " := ", " => "), self.one('"', "'", "")
        kind = (0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 8, 9, 9, 9, 9, 10, 11)[n(0, 18)]
        if kind in (1, 2, 8, 9):
            if self.r.random() < 0.15:
                key, sign = self.one('"', "'") + key, self.one('": ', '" : ', "': ")
            elif self.r.random() < 0.1:
                key, sign = self.one(key, "Bearer"), self.one(" ", " is ")
        if kind == 8:
            cap = self.one(*WORDS).capitalize() if n(0, 3) == 0 else self.one(*WORDS)
            many = self.of("!@#$%^&*_-", n(1, 3)) + self.of(dig, n(1, 5))
            c = self.one(cap + many, cap + self.of(dig, n(1, 4)) + self.of("!@#$%^&*", n(1, 3)), cap[:2] + "@" + cap[2:] + many, self.of(every + "!@#$%^&*", n(8, 17)))
            return self.prose() + key + sign + q, (c + self.of("!@#$%", 8))[: max(8, len(c))], q + " " + self.prose()
        if kind == 9:
            c = self.one("".join(self.one(*WORDS) for _ in range(n(2, 5))), "-".join(self.one(*WORDS) for _ in range(n(3, 5))), self.of(up + low, n(10, 30)), self.of(low, n(10, 30)))
            return self.prose() + key + self.one("=", " = ", ":", ": ") + q, (c + self.of(low, 14))[: max(14, len(c))], q + " " + self.prose()
        if kind == 11:
            what, lines = self.one("RSA ", "EC ", "OPENSSH ", ""), "\n".join(self.of(every + "+/", 64) for _ in range(n(1, 8)))
            return self.prose(), f"-----BEGIN {what}PRIVATE KEY-----\n{lines}\n-----END {what}PRIVATE KEY-----", " " + self.prose()
        if kind == 10:
            return self.prose() + q, self.one("AKIA" + self.of(up, 16), "ASIA" + self.of(up, 16), self.one("ghp_", "gho_") + self.of(up + low, 36), self.one("sk_live_", "sk-", "npm_", "hf_") + self.of(up + low, n(20, 44))), q + " " + self.prose()
        if kind == 0:
            return self.prose() + self.one("", "", "key "), self.one("AKIA", "ASIA") + self.of(up + "234567" + dig, 16), " " + self.prose()
        if kind == 1:
            return self.prose() + key + sign + q, self.of(hexa, self.one(16, 18, 20, 24, 32, 40, 64)), q + " " + self.prose()
        if kind == 2:
            return self.prose() + key + sign + q, self.of(every, n(16, 48)), q + " " + self.prose()
        if kind == 3:
            return self.prose() + q, self.one("ghp_", "gho_", "ghs_") + self.of(every, 36), q + " " + self.prose()
        if kind == 4:
            return self.prose() + q, self.one("sk_live_", "rk_live_", "sk-", "glpat-", "xoxb-", "hf_", "npm_") + self.of(every, n(20, 44)), q + " " + self.prose()
        if kind == 5:
            return self.prose() + q, "AIza" + self.of(every + "_-", 35), q + " " + self.prose()
        if kind == 6:
            return self.prose() + q, "eyJ" + self.of(every, n(20, 60)), ".eyJ" + self.of(every, 20)
        return self.prose() + q, self.of(every + "+/", n(32, 64)), q + self.one("", "=") + " " + self.prose()

    def harmless(self) -> tuple[str, str, str]:
        hexa, dig, n = "0123456789abcdef", "0123456789", lambda a, b: int(self.r.integers(a, b))
        kind = n(0, 14)
        if kind == 11:
            key = self.one("password", "Password", "secret", "The secret", "token", "tokens", "access key", "API key", "bearer", "credentials", "private key", "auth", "passphrase")
            return self.prose() + key + self.one(" ", " ", " is ", ": ", ":"), self.one(*PLAIN), self.one(" ", ". ", ", ") + self.prose()
        if kind == 12:
            return self.prose() + self.one("password", "token", "api_key", "secret", "API_KEY", "pwd") + self.one("=", ": ", " = ", '": "'), self.one("changeme", "placeholder", "required", "undefined", "your-password", "example-token", "YOUR_API_KEY", "********", "xxxxxxxxxx", "dummyvalue", "sample-secret"), self.one(" ", '" ', ", ") + self.prose()
        if kind == 13:
            return self.prose(), self.one("sk-", "hf_", "npm_") + self.one("-", "_").join(self.one(*WORDS) for _ in range(n(2, 4))), " " + self.prose()
        if kind == 0:
            h = self.of(hexa, 32)
            return self.prose() + self.one("", "id ", "uuid=", "request "), f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", " " + self.prose()
        if kind == 1:
            return self.prose() + self.one("commit ", "sha256:", "md5: ", "sha1=", "checksum ", "etag: ", "digest ", "rev "), self.of(hexa, self.one(12, 32, 40, 64)), " " + self.prose()
        if kind == 2:
            return self.prose() + self.one("http://", "https://", "www.") + self.word() + self.one(".com/", ".org/a/", ".net/img/"), self.word() + "/" + self.of(dig, n(4, 9)) + self.one("", "/" + self.word()), self.one(".html ", ".jpg ", " ", "?p=1 ")
        if kind == 3:
            return self.prose() + self.one("", "phone ", "tel: ", "+"), self.of(dig, n(12, 17)), " " + self.prose()
        if kind == 4:
            return self.prose(), f"20{self.of(dig, 2)}-0{n(1, 9)}-1{n(0, 9)}T1{n(0, 9)}", ":00:00 " + self.prose()
        if kind == 5:
            return self.prose(), self.word() + self.one("-", "_", "") + self.word() + "-" + self.word() + self.one("-", "_", "") + self.of(dig, n(1, 4)), " " + self.prose()
        if kind == 6:
            return self.prose() + self.one("order ", "invoice #", "ref ", "isbn ", "doi ", "id="), self.one("ORD-", "INV-", "", "978-") + self.of(dig, n(8, 12)), " " + self.prose()
        if kind == 7:
            return self.prose() + self.one("password=", "token: ", "api_key=", "secret="), self.one("x" * n(6, 12) + "1234", "your-api-key-1", "example-password-1", "changeme12345678", "0" * n(12, 20), "placeholder-token-1"), " " + self.prose()
        if kind == 8:
            return self.prose() + self.one("version ", "build ", "v"), f"{n(1, 9)}-{n(0, 20)}-{n(0, 99)}-{self.one('release', 'beta', 'alpha')}-{n(1, 20)}", " " + self.prose()
        if kind == 9:
            return self.prose(), "".join(self.word() for _ in range(n(3, 8)))[:40].encode("ascii", "ignore").decode() + self.of(dig, n(1, 4)), self.one(". ", ", ", " ") + self.prose()
        return self.prose() + self.one("/", "/usr/", "C:\\", "./"), self.word() + "/" + self.word() + "_" + self.of(dig, n(1, 6)), self.one(".py ", ".txt ", ".log ") + self.prose()

    def rows(self, n: int) -> list[tuple[str, str, str, int]]:
        return [(*(self.secret() if i % 2 else self.harmless()), i % 2) for i in range(n)]


def train(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, seed: int = 5) -> list:
    """A random forest: bootstrap rows, a random third of the features at each node, Gini splits. A tree is (feature, cut, low, high) or a share."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray, left: int):
        share = float(y[rows].mean()) if len(rows) else 0.0
        if left == 0 or share in (0.0, 1.0) or len(rows) < 6:
            return round(share, 4)
        best = (1e-9, None)
        for j in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
            order = rows[np.argsort(x[rows, j], kind="stable")]
            v, t = x[order, j], y[order].cumsum()
            at = np.flatnonzero(v[1:] > v[:-1])
            if not len(at):
                continue
            n, k = len(rows), at + 1
            p, q = t[at] / k, (t[-1] - t[at]) / (n - k)
            gain = share * (1 - share) - (k * p * (1 - p) + (n - k) * q * (1 - q)) / n
            g = int(gain.argmax())
            if gain[g] > best[0]:
                best = (float(gain[g]), (int(j), float((v[at[g]] + v[at[g] + 1]) / 2)))
        if best[1] is None:
            return round(share, 4)
        j, c = best[1]
        low = x[rows, j] <= c
        return j, c, grow(rows[low], left - 1), grow(rows[~low], left - 1)

    return [grow(rng.integers(0, len(x), len(x)), depth) for _ in range(trees)]


def forest(trees: list, f: Column) -> Column:
    """The mean of the trees' shares as conditions on the features' array."""

    def tree(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        return F.when(F.get(f, F.lit(t[0])) <= t[1], tree(t[2])).otherwise(tree(t[3]))

    total = tree(trees[0])
    for t in trees[1:]:
        total = total + tree(t)
    return total / len(trees)


def fit(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None, n: int = 1600) -> list:
    """Trains on labelled findings (left, candidate, right, label); without any, on `n` generated ones. Features come from the same
    columns as in a scan; what returns to the driver is one short array a finding."""
    rows = findings if findings is not None else Findings(3).rows(n)
    data = json.dumps([{"l": a, "c": c, "r": b, "y": y} for a, c, b, y in rows])
    df = spark.range(1).select(F.inline(F.from_json(F.lit(data), "array<struct<l:string,c:string,r:string,y:int>>")))
    got = df.select(features(F.col("c"), F.col("l"), F.col("r")).alias("f"), "y").collect()
    return train(np.array([r["f"] for r in got]), np.array([r["y"] for r in got], float))


def scored(text: Column, trees: list) -> Column:
    """An array of structs (piece, score): every piece of the text, with the forest's score for candidates and null for context."""
    bound = F.array(candidates(text))  # the array of one binds the pieces to a variable, so they are made once

    def piece(p: Column, i: Column, all_: Column) -> Column:
        f = F.array(features(plain(p), plain(F.get(all_, i - 1)), plain(F.coalesce(F.get(all_, i + 1), F.lit("")))))
        score = F.get(F.transform(f, lambda v: forest(trees, v)), F.lit(0))
        return F.struct(plain(p).alias("piece"), F.when(i % 2 == 1, score).alias("score"))

    return F.get(F.transform(bound, lambda a: F.transform(a, lambda p, i: piece(p, i, a))), F.lit(0))


def scan(docs: DataFrame, threshold: float = 0.5, trees: list | None = None) -> DataFrame:
    """doc_id, ordinal, value, n_chars, score, is_secret: every candidate of every whole text, in order (from 1).

    Null and empty texts have none. Repeated rows give repeated findings; a null id stays null. `is_secret` is the forest's decision.
    """
    trees = fit(docs.sparkSession) if trees is None else trees
    parts = docs.select("doc_id", F.posexplode(scored(F.col("text"), trees)).alias("i", "p"))
    return parts.where(F.col("i") % 2 == 1).select(
        "doc_id",
        F.expr("(i + 1) div 2").cast("int").alias("ordinal"),
        F.col("p.piece").alias("value"),
        F.length("p.piece").alias("n_chars"),
        F.round("p.score", 6).alias("score"),
        (F.col("p.score") >= threshold).alias("is_secret"),
    )


def redact(docs: DataFrame, threshold: float = 0.5, trees: list | None = None) -> DataFrame:
    """The same rows and columns with every secret replaced by MASK; n_chars, where there is one, follows a changed text.

    Texts without secrets, null and empty ones among them, stay as they are to the letter. No shuffle.
    """
    trees = fit(docs.sparkSession) if trees is None else trees
    pieces = fresh(docs, "pieces")
    hit = F.coalesce(F.exists(pieces, lambda p: F.coalesce(p["score"] >= threshold, F.lit(False))), F.lit(False))
    masked = F.array_join(F.transform(pieces, lambda p: F.when(p["score"] >= threshold, F.lit(MASK)).otherwise(p["piece"])), "")
    out = docs.withColumn(pieces, scored(F.col("text"), trees))
    if any(c.lower() == "n_chars" for c in docs.columns):
        kind = dict(docs.dtypes)[next(c for c in docs.columns if c.lower() == "n_chars")]
        out = out.withColumn("n_chars", F.when(hit, F.length(masked).cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.when(hit, masked).otherwise(F.col("text"))).drop(pieces)
