"""Secret scans: fixed patterns, and strings that a character Markov model finds random; with DataFrame functions only.

Two first-order models over character classes are trained from labelled samples: random strings and ordinary identifiers. A candidate is a secret when the
log-likelihood ratio of the two over its characters is large enough. Spans count code points; their end is exclusive.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the base patterns ----
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the leftmost run of 20 characters or more; shorter runs hold no longer one
HEX = r"[0-9a-f]{24,}"
NAMES = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "markov")
# ---- end of fixed values ----

#: Candidates of the Markov model, and the least log-likelihood ratio (nats) of a secret.
CANDIDATE, LEAST = r"[A-Za-z0-9+/_=-]{20,}", 12.0
CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Words that ordinary identifiers of the labelled sample are made of.
WORDS = (
    "account action address admin agent alert amount analysis api application archive array asset author balance base batch block body buffer build button cache call "
    "category change channel char check child class client clock cloud cluster code collection column command comment common component config connection container "
    "content context control cookie copy core count country create current customer data database date default delete delta device dialog digest directory document "
    "domain driver edge element email encoder engine entity entry error event example exception export factory feature field file filter find first flag folder font "
    "format frame function gateway global graph group handler hash header height history host html image import index info initial input insert instance integer "
    "interface internal invoice item iterator join json key label language last layer layout length level library license limit line link list loader local location "
    "logger login machine main manager mapper matrix memory menu message meta method metric model module monitor month name network node note number object offset "
    "open operator option order origin output owner package page panel parameter parent parser partition path pattern payload payment pending phone pipeline pixel "
    "plugin point policy pool port position prefix previous price process product profile project property protocol provider proxy public query queue random range "
    "reader record reference region register release remote render report request resource response result return role root route router rule runtime sample scale "
    "schedule schema scope screen search section segment select sequence server service session setting shape share signal simple size source space stack stage state "
    "static status step storage store stream string style subject summary switch system table target task template test text thread time timeout title token total "
    "trace tracking transaction transform trigger type unit update upload user utility value variable vector version video view virtual visible warning weight widget "
    "width window worker writer zone"
).split()


def labelled_sample(n: int = 4000) -> list[tuple[str, bool]]:
    """Strings and whether they are random: base-62, hexadecimal and upper-case digests against identifiers in the usual styles, both made by a fixed rule."""
    out = []
    for i in range(n):
        d = hashlib.sha512(str(i).encode()).digest()
        alphabet = (CHARS, "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", CHARS)[i % 4]
        out.append(("".join(alphabet[b % len(alphabet)] for b in d[: 20 + i % 21]), True))
        w = [WORDS[int.from_bytes(d[2 * k : 2 * k + 2], "big") % len(WORDS)] for k in range(3 + i % 3)]
        joined = ("_".join(w), "-".join(w), w[0] + "".join(x.title() for x in w[1:]), "".join(x.title() for x in w), "".join(w), "_".join(w).upper())[i % 6]
        out.append((joined + ("", "", str(d[40] % 100), f"_{2000 + d[41] % 30}")[i // 6 % 4], False))
    return out


def klass(c: str) -> int:
    return CHARS.index(c) + 1 if c in CHARS else 0


def ratios(sample: list[tuple[str, bool]]) -> list[float]:
    """Log ratio, random over ordinary, of each pair of classes (63 by 63), from transition counts of the labelled sample with one added to each."""
    size = len(CHARS) + 1
    table = {}
    for label in (True, False):
        counts = [[1.0] * size for _ in range(size)]
        for text, is_random in sample:
            if is_random == label:
                for a, b in zip(text, text[1:]):
                    counts[klass(a)][klass(b)] += 1
        table[label] = [[math.log(x / sum(row)) for x in row] for row in counts]
    return [round(r - o, 4) for x, y in zip(table[True], table[False]) for r, o in zip(x, y)]


def _spans(kind: str, text: Column, regex: str, keep, group: int = 0) -> Column:
    """Spans of a pattern's matches: the text between matches and the matches are measured in turn. keep(match, group) filters."""
    zipped = F.arrays_zip(F.split(text, regex, -1).alias("p"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("g"))
    one = lambda s, e: F.struct(s.alias("s"), F.lit(KINDS.index(kind)).alias("k"), e.alias("e"))
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")

    def step(acc, x):
        s = acc.at + F.length(x.p)
        e = s + F.coalesce(F.length(x.m), F.lit(0))
        return F.struct(e.alias("at"), F.when(x.m.isNotNull() & keep(x.m, x.g), F.array_append(acc.out, one(s, e))).otherwise(acc.out).alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc.out)


def found(text: Column, least: float = LEAST) -> Column:
    """Array of (s, k, e), ordered by start, then kind: k is the position in KINDS."""
    table = F.lit(ratios(labelled_sample()))
    classes = F.lit([klass(chr(c)) for c in range(128)])
    at = lambda ch: F.element_at(classes, F.ascii(ch) + 1)

    def score(m, _):
        chars = F.split(m, "")
        pairs = F.arrays_zip(chars.alias("a"), F.slice(chars, 2, F.length(m)).alias("b"))
        total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when(F.coalesce(F.length(p.a) * F.length(p.b), F.lit(0)) == 1, F.element_at(table, at(p.a) * (len(CHARS) + 1) + at(p.b) + 1)).otherwise(F.lit(0.0)))
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (total >= least)

    low = F.lower(text)
    named = low.contains(NAMES[0])
    for n in NAMES[1:]:
        named = named | low.contains(n)
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    always = lambda m, g: F.lit(True)
    parts = [
        F.when(named, _spans("assign", text, ASSIGN, lambda m, g: F.length(g) >= 6, 2)).otherwise(none),
        F.when(text.contains("AKIA"), _spans("access", text, ACCESS, always)).otherwise(none),
        F.when(text.rlike(HEX), _spans("hex", text, HEX, always)).otherwise(none),
        F.when(text.rlike(CANDIDATE), _spans("markov", text, CANDIDATE, score)).otherwise(none),
    ]
    return F.array_sort(F.concat(*parts))


def scanned(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs with secrets array<struct<s, k, e>>: start, kind (position in KINDS) and end in code points of every secret in the whole text.

    The kinds are found apart, so spans of different kinds may overlap; Markov candidates are runs of 20 or more of A-Z a-z 0-9 + / _ = - that hold a digit and
    a letter. Null text is empty and holds none. Every row is kept, repeated ones too; a column named secrets is replaced. A projection: nothing is shuffled.
    """
    return docs.withColumn("secrets", found(F.coalesce(F.col(text_col), F.lit("")), least))


def listed(kinds: int = len(KINDS)) -> Column:
    """kind:start:end of the first `kinds` kinds, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    own = F.filter("secrets", lambda x: x.k < kinds)
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", F.element_at(names, x.k + 1), x.s.cast("string"), x.e.cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", least: float = LEAST) -> DataFrame:
    """docs with every secret's span replaced by `mark` (overlapping spans by one); texts without secrets, null ones too, stay as they are."""
    d = scanned(docs, text_col, least)
    text = F.col(text_col)

    def step(acc, x):
        fresh = x.s >= acc.at
        out = F.when(fresh, F.concat(acc.out, F.substring(text, acc.at + 1, x.s - acc.at), F.lit(mark))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, x.e).alias("at"), out.alias("out"))

    new = F.aggregate("secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a.out, F.substring(text, a.at + 1, F.length(text))))
    return d.withColumn(text_col, F.when(F.size("secrets") > 0, new).otherwise(text)).drop("secrets")
