"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A rule (host, path prefix) fits its host and all subdomains when the url's path starts with the rule's; the longest
fitting rule decides. Where none fits, an automaton over all terms reads the ASCII-lower-cased url once, after the
percent-escapes of ASCII letters and digits are resolved (%70orn is porn); a hit counts only between boundaries (no
ASCII letter or digit beside it). One strict term, or at least two distinct soft terms whose weights sum to at least
`limit`, reject the url. Two spellings of one root (casino, casinos) count as one soft term, of the larger weight.

The built-in vocabulary grows by rule out of roots in English, Spanish, French and German: roots take plural endings,
and the roots of compounds also join other words without a separator (pornotube, casinobonus). A vocabulary of one's own
is a table (term, root, weight; a null weight makes a strict term), read by vocabulary().

Rules and terms are parameters, not data: more than MAX_TERMS of either are refused with an error, so shipping them to
tasks has a proven bound. The work is a narrow map over url alone; no shuffle.

Defined results: a null url, or one without ://, has empty host and path, so no rule fits; its verdict is the
vocabulary's over the whole string (null: allow). A very long url is read whole, once. Repeated rows are judged alike;
rows of null page_id come back as null; an empty table gives an empty result; other columns are dropped by judge()
except those named in keep, which must not bear the names of the added ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

MAX_TERMS = 1_000_000
#: (host, path, verdict), fixed by the query's contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
# The roots of the vocabulary. One strict term rejects a url.
STRICT = """porn porno pornography hentai hardcore xxx xnxx camgirl sexcam sextape milf nsfw escort callgirl bdsm fetish incest upskirt
warez crackz keygen serialz nulled malware carding
pornografia puta culona pornographie prostituée salope pornografie nutte nutten sexkontakte""".split()
#: Soft roots by weight: what hardly ever is innocent, what often is not, and what only counts beside others.
SOFT = {
    1.5: """casino poker betting bet slots roulette blackjack jackpot sportsbook bookmaker viagra cialis pill xanax tramadol steroids
casa-de-apuestas apuesta tragaperras ruleta paris-sportifs sportwetten wetten spielautomaten potenzmittel""".split(),
    1.0: """adult sex sexy nude naked erotic erotica dating hookup torrent cracked hacked replica counterfeit payday loan forex binary-options
desnuda sexo erotico cita prestamo nue sexe erotique rencontre pret nackt erotik seitensprung kredit""".split(),
    0.5: """free win winner bonus cheap discount cash prize lottery crypto download stream live hot girl deal offer click
gratis ganar premio barato descargar gratuit gagner prix pas-cher kostenlos gewinn billig gutschein""".split(),
}
#: Roots that also stand before these without a separator.
COMPOUNDS = ("porn", "porno", "sex", "xxx", "adult", "casino", "poker", "bet")
HEADS = ("tube", "cam", "cams", "chat", "club", "games", "hub", "live", "movies", "online", "pics", "shop", "site", "video", "videos", "world", "bonus", "win")
LIMIT, DISTINCT = 2.0, 2
_FOLD = str.maketrans(UPPER, LOWER)
_WORD = frozenset(LOWER + "0123456789")
_ESCAPE = re.compile("%(3[0-9]|[46][1-9a-f]|[57][0-9a])")


def built_in() -> list[tuple[str, str, float | None]]:
    """(term, root, weight) of the built-in vocabulary, null weights for strict terms: roots, their plurals, their compounds."""
    roots = [(r, None) for r in STRICT] + [(r, w) for w, some in SOFT.items() for r in some]
    out: dict[str, tuple[str, str, float | None]] = {}
    for root, weight in roots:
        for end in ("",) if root.endswith("s") else ("", "es") if root.endswith(("x", "z", "ch")) else ("", "s"):
            out.setdefault(root + end, (root + end, root, weight))
        if root in COMPOUNDS:
            for head in HEADS:
                out.setdefault(root + head, (root + head, root, None if weight is None or root in ("sex", "adult") else weight))
    return list(out.values())


def vocabulary(terms: DataFrame) -> list[tuple[str, str, float | None]]:
    """A vocabulary from a table (term, root, weight); a null root stands for the term itself. Refused beyond MAX_TERMS rows."""
    rows = terms.select("term", F.coalesce("root", "term").alias("root"), F.col("weight").cast("double")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS or not all(r.term for r in rows):
        raise ValueError(f"a vocabulary has at most {MAX_TERMS} terms, none empty")
    return [(r.term.translate(_FOLD), r.root, r.weight) for r in rows]


def plain(url: str) -> str:
    """The url as the automaton reads it: A-Z lower-cased, escapes of ASCII letters and digits resolved, once."""
    return _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)).translate(_FOLD) if chr(int(m.group(1), 16)).isalnum() else m.group(), url.translate(_FOLD))


class Vocabulary:
    """The automaton, built once per task."""

    def __init__(self, terms: Sequence[tuple[str, str, float | None]]):
        self.automaton = ahocorasick.Automaton()
        for term, root, weight in terms:
            self.automaton.add_word(term, (len(term), root, weight))
        self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[int, int, float]:
        """Distinct strict roots, distinct soft roots, and the sum of the latter's weights."""
        strict, soft = set(), {}
        for end, (size, root, weight) in self.automaton.iter(url):
            start = end - size + 1
            if (start == 0 or url[start - 1] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
                if weight is None:
                    strict.add(root)
                else:
                    soft[root] = max(weight, soft.get(root, weight))
        return len(strict), len(soft), float(sum(sorted(soft.values())))


def longest_rule(rules: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; rules: by host, (path, verdict)."""
    best = None
    while host:
        for prefix, verdict in rules.get(host, ()):
            if path.startswith(prefix) and (best is None or len(host + prefix) > len(best[0])):
                best = (host + prefix, verdict)
        host = host.partition(".")[2]
    return best


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path as the contract defines them."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return df.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


def judge(df: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), rules=RULES, terms: Sequence[tuple[str, str, float | None]] | None = None, limit: float = LIMIT) -> DataFrame:
    """keep, host, path, rule, verdict, strict_hits, soft_hits, soft_weight for every row; terms as built_in() and vocabulary() give them."""
    terms = built_in() if terms is None else terms
    if max(len(rules), len(terms)) > MAX_TERMS or not all(t for t, _, _ in terms):
        raise ValueError(f"rules and terms must not be empty strings, nor more than {MAX_TERMS}")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, prefix, verdict in rules:
        by_host.setdefault(host, []).append((prefix, verdict))
    d = split_url(df, url).select(*keep, F.coalesce(F.col(url), F.lit("")).alias("_url"), "host", "path")
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(terms)
        for b in batches:
            url_, host_, path_ = (b.column(c).to_pylist() for c in ("_url", "host", "path"))
            found = [longest_rule(by_host, h, p) for h, p in zip(host_, path_, strict=True)]
            hits = [words.hits(plain(u)) for u in url_]
            bad = [strict > 0 or soft >= DISTINCT and weight >= limit for strict, soft, weight in hits]
            new = {
                "rule": pa.array([f[0] if f else None for f in found], pa.string()),
                "verdict": pa.array([f[1] if f else "block" if x else "allow" for f, x in zip(found, bad, strict=True)], pa.string()),
                "strict_hits": pa.array([h[0] for h in hits], pa.int32()),
                "soft_hits": pa.array([h[1] for h in hits], pa.int32()),
                "soft_weight": pa.array([h[2] for h in hits], pa.float64()),
            }
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*keep, "host", "path")], *new.values()], [*keep, "host", "path", *new])

    return d.mapInArrow(scan, f"{kept}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, soft_weight double")


def _resolved(u: str) -> str:
    """SQL for plain(): one replace a code. A result never completes an escape that is still to come: a to f after the codes that end in them, 3 last."""
    letters = [c for c in range(0x61, 0x7B)] + [c for c in range(0x41, 0x5B)]
    hexes = [c for c in letters if chr(c).lower() in "abcdef"]
    for c in [c for c in letters if c not in hexes] + hexes + [c for c in range(0x30, 0x3A) if c != 0x33] + [0x33]:
        u = f"replace({u}, '%{c:02x}', '{chr(c).lower()}')"
    return u


def oracle_sql() -> str:
    """The query in DuckDB SQL: a root is hit where a regular expression of its terms matches; strict and soft terms of a root are two roots."""
    groups: dict[tuple[str, float | None], list[str]] = {}
    for term, root, weight in built_in():
        groups.setdefault((root, weight), []).append(term)
    strict = ", ".join(f"('{'|'.join(t)}')" for (_, w), t in groups.items() if w is None)
    soft = ", ".join(f"('{'|'.join(t)}', CAST({w} AS DOUBLE))" for (_, w), t in groups.items() if w is not None)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS raw, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (SELECT row_number() OVER () AS k, page_id, {_resolved(f"translate(raw, '{UPPER}', '{LOWER}')")} AS u, regexp_extract(r, '^[^/?#]*') AS h, r FROM a),
c AS (SELECT k, page_id, u, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM b),
strict(t) AS (VALUES {strict}), soft(t, w) AS (VALUES {soft}),
hs AS (SELECT u, count(*) AS n FROM (SELECT DISTINCT u FROM c), strict WHERE regexp_matches(u, '(^|[^a-z0-9])(' || t || ')([^a-z0-9]|$)') GROUP BY u),
hw AS (SELECT u, count(*) AS n, sum(w) AS w FROM (SELECT DISTINCT u FROM c), soft WHERE regexp_matches(u, '(^|[^a-z0-9])(' || t || ')([^a-z0-9]|$)') GROUP BY u),
rules(rh, rp, rv) AS (VALUES {rules}),
d AS (SELECT c.*, coalesce(hs.n, 0) AS strict_hits, coalesce(hw.n, 0) AS soft_hits, coalesce(hw.w, 0) AS soft_weight,
 (SELECT max_by(struct_pack(rule := rh || rp, v := rv), length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS f
 FROM c LEFT JOIN hs ON c.u = hs.u LEFT JOIN hw ON c.u = hw.u)
SELECT page_id, host, path, f.rule AS rule,
 coalesce(f.v, CASE WHEN strict_hits > 0 OR soft_hits >= {DISTINCT} AND soft_weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
 CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits, CAST(soft_weight AS DOUBLE) AS soft_weight FROM d"""
