"""Personal data by weak supervision (operator 2).

Strict patterns give the base spans, which always stay. Looser forms propose
further spans: addresses spelt out, telephone numbers without a plus, cards in
other groupings or with a wrong check digit, addresses of eight groups, and as a
kind of their own secrets (named ones, known key forms, key blocks, and bare runs
of letters and digits). Most of these are doubtful: a bare run may be a check
sum, ten digits an order number. On every proposal, base ones too, labelers vote
yes, no or nothing:

* form: how regular its grouping is;
* check: Luhn, octets, number and variety of digits, entropy;
* listed, gazetteers: top-level domains, issuer prefixes, trunk and country
  prefixes, reserved networks, key prefixes;
* announced: words before it that announce its kind;
* foreign: words before it that announce something else;
* edges: what touches its ends.

Votes are counted by kind and pattern over all documents. Expectation-
maximisation on those counts estimates every labeler's reliability without
labels, by kind (a labeler is never taken to be worse than chance), and the
resulting probabilities train the final classifier, a logistic regression on the
votes and the span's length, weighted by the patterns' shares, so that it behaves
alike at every size. A proposal is taken if the classifier gives it ``threshold``
or more. Only pattern counts reach the driver; their number follows from the
labelers, not from the documents.

Defined results: a null or empty text has no spans; offsets are code points, end
exclusive; proposals that overlap a base span or an earlier proposal are left,
but a secret only where one base span covers its value; a named or bare secret
has 16 or 24 characters at least, and no secret has an upper bound; a key block
without an end goes as far as its letters; rows with equal ids are separate
documents; without any proposal the classifier takes nothing; an empty table
gives no rows; further columns are not read. All scans take time in proportion
to a text's length, whatever it holds.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm._arrays import pieces

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: The base patterns' parts. Addresses are read from their @ and chains of octets as a whole, with the results of a scan from the left.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser forms.
AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}| at ) ?(?=[A-Za-z0-9])")
SPELT = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]+){1,4}")
CHAIN = re.compile(r"(?<![\w.+-])\(?[0-9]+\)?(?:[\x20./-]{1,2}\(?[0-9]+\)?)*")
GROUP = re.compile(r"[0-9]+")
GROUPS = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,}")
NAMED = re.compile(r"(?:api[_-]?key|access[_-]?key|secret|token|passwo?r?d)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_=.-]{15,}[A-Za-z0-9+/_=-])", re.IGNORECASE)
KEYED = re.compile(r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)")
BEGIN = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
LETTERS = re.compile(r"[A-Za-z0-9+/=\s]*")
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")
DIGIT = re.compile(r"[0-9]")
#: Gazetteers and announcing words.
TLDS = frozenset("com org net edu gov int mil io co info biz uk de fr es it nl be ch at eu us ca au jp cn ru br in pl se no dk fi pt cz".split())
ANNOUNCE = {
    "email": frozenset("email e-mail mail contact courriel correo write".split()),
    "ip": frozenset("ip ipv6 address host server addr adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit carte karte tarjeta payment".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell whatsapp telefon téléphone teléfono".split()),
    "secret": frozenset("key secret token password passwd pwd credential credentials bearer authorization".split()),
}
OTHERS = frozenset("isbn issn doi version order invoice id ref sku page no nr total serial article item ticket".split())
SUMS = frozenset("sha sha1 sha256 sha512 md5 commit hash checksum digest etag uuid guid build revision fingerprint integrity".split())
WORD = re.compile(r"[^\W_][\w-]*")
LABELERS = ("form", "check", "listed", "announced", "foreign", "edges")
START = np.array([1, 1, 1, 2, 2, 1])
TAKEN = "doc_id long, text string, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost addresses: an @ with the run before it, no further back than the last one's end."""
    at, last = text.find("@"), 0
    while at >= 0:
        s = at
        while s > last and text[s - 1] in LOCAL_CHARS:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
        last = m.end() if m else at + 1
        at = text.find("@", last)


def addresses(text: str):
    """Four numbers at a time of every chain of numbers and dots, if all are octets."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, numbers = m.start(), m[0].split(".")
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


class Finder:
    """Base spans, proposals and votes of one text at a time."""

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place of the kind, end) in order."""
        out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
        if DIGIT.search(text):
            if "." in text:
                out += [(s, 1, e) for s, e in addresses(text)]
            out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
            if "+" in text:
                out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
        return sorted(out)

    def _numbers(self, text: str):
        """Cards and telephone numbers among the groups of a chain of digits."""
        for m in CHAIN.finditer(text):
            if m.end() - m.start() < 9:
                continue
            groups = [(g.start(), g.end()) for g in GROUP.finditer(text, m.start(), m.end())]
            size = [e - s for s, e in groups]
            if len(groups) == 1 or size[0] == 0:
                kind = "phone" if 10 <= size[0] <= 12 else "card" if 13 <= size[0] <= 19 and luhn(text[slice(*groups[0])]) else None
                if kind:
                    yield kind, groups[0][0], groups[0][1]
                continue
            first = text[groups[0][0] : groups[0][1]]
            if (first[:1] == "0" or text[m.start()] == "(") and len(groups) <= 6 and 9 <= sum(size) <= 15 and max(size) <= 8:
                yield "phone", m.start(), groups[-1][1]
                continue
            i = 0
            while i < len(groups):
                kind, n = ("card", 4) if size[i : i + 4] == [4] * 4 else ("card", 3) if size[i : i + 3] == [4, 6, 5] else ("phone", 3) if size[i : i + 3] == [3, 3, 4] else (None, 1)
                if kind:
                    yield kind, groups[i][0], groups[i + n - 1][1]
                i += n

    def _secrets(self, text: str):
        """(start, end, start of the value)."""
        low = text if text.islower() else text.lower()
        if any(w in low for w in ("key", "secret", "token", "passw")):
            yield from ((m.start(), m.end(), m.start(1)) for m in NAMED.finditer(text))
        yield from ((m.start(), m.end(), m.start()) for m in KEYED.finditer(text))
        if "-----BEGIN" in text:
            ends = [(m.start(), m.end()) for m in END.finditer(text)]
            begins = list(BEGIN.finditer(text))
            for n, m in enumerate(begins):
                at = bisect_left(ends, (m.end(), 0))
                following = begins[n + 1].start() if n + 1 < len(begins) else len(text)
                if at < len(ends) and ends[at][0] < following:
                    yield m.start(), ends[at][1], m.start()
                else:
                    run = LETTERS.match(text, m.end(), following)
                    yield m.start(), m.end() + len(run[0].rstrip()), m.start()
        if DIGIT.search(text):
            for m in BARE.finditer(text):
                body = m[0]
                plain = body.isalnum() and all(c in "0123456789abcdefABCDEF" for c in body)
                if (plain and len(body) >= 32 and not body.isdigit()) or (not plain and any(c.isdigit() for c in body) and any(c.islower() for c in body) and any(c.isupper() for c in body)):
                    yield m.start(), m.end(), m.start()

    def proposed(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
        """Loose spans that touch no earlier one nor a base span; secrets may hold base spans."""
        found = []
        last = 0
        for m in AT.finditer(text):
            s = m.start()
            while s > last and text[s - 1] in LOCAL_CHARS:
                s -= 1
            domain = SPELT.match(text, m.end()) if s < m.start() else None
            if domain and text[domain.end() - 1].isalpha() and (m[0].strip() != "at" or " dot " in domain[0]):
                found.append((s, domain.end(), "email", s))
            last = m.end()
        if DIGIT.search(text):
            found += [(s, e, kind, s) for kind, s, e in self._numbers(text)]
            if text.count(":") >= 2:
                found += [(m.start(), m.end(), "ip", m.start()) for m in GROUPS.finditer(text) if m[0].count("::") == 1 and len(m[0]) > 4 or m[0].count(":") == 7 and "::" not in m[0]]
        found += [(s, e, "secret", value) for s, e, value in self._secrets(text)]
        if not found:
            return []
        start, reach = [s for s, _, _ in base], np.maximum.accumulate([e for _, _, e in base]).tolist() if base else []
        # secrets first where two begin together; a longer one swallows the shorter
        found.sort(key=lambda f: (f[0], f[2] != "secret", -f[1]))
        busy, out = 0, []
        for s, e, kind, value in found:
            if s < busy:
                continue
            before = bisect_right(start, value if kind == "secret" else e - 1)
            far = reach[before - 1] if before else -1
            if (far < e) if kind == "secret" else (far <= s):
                out.append((kind, s, e))
                busy = e
        return out

    def votes(self, text: str, kind: str, s: int, e: int) -> tuple[int, ...]:
        """One vote a labeler: 1, -1, or 0 for none; then the span's length class."""
        span = text[s:e]
        near = [w.lower() for w in WORD.findall(text[max(0, s - 60) : s])[-5:]]
        near = {*near, *(p for w in near for p in re.split("[-_]", w))}
        left, right = text[s - 1 : s] if s else "", text[e : e + 1]
        edges = -1 if left.isalnum() or right.isalnum() or left in ("/", "_", "#", ".", "-", ":") and left else 1
        foreign = -1 if near & (SUMS if kind == "secret" else OTHERS) else 0
        announced = 1 if near & ANNOUNCE[kind] else 0
        if kind == "email":
            form = 1 if "@" in span or "(" in span or "[" in span or "{" in span else -1
            check = 1 if any(c.isalpha() for c in re.split(r"@|[({\[ ]at[)}\] ]", span)[0]) else -1
            listed = 1 if re.split(r"[^a-z]+", span.lower())[-1] in TLDS else -1
        elif kind == "ip":
            form = 1 if span.count(".") == 3 or span.count(":") >= 4 else -1
            check = 1 if "." in span or (any(c.isdigit() for c in span) and len(_digits(span)) > 2) else -1
            listed = -1 if span.startswith(("0.", "127.", "255.")) else 1 if "." in span or span[:2].lower() in ("20", "26", "2a", "fe", "fd", "fc") else 0
        elif kind == "card":
            d = _digits(span)
            sizes = [len(g) for g in GROUP.findall(span)]
            form = 1 if sizes in ([4] * 4, [4, 6, 5]) else 0 if len(sizes) == 1 else -1
            check = 1 if luhn(d) else -1
            listed = 1 if d[:1] in ("3", "4", "5", "6") and len(d) >= 14 else -1
        elif kind == "phone":
            d = _digits(span)
            sizes = [len(g) for g in GROUP.findall(span)]
            form = 1 if span[0] in "+(" or len(sizes) >= 3 else 0 if len(sizes) == 2 else -1
            check = 1 if 9 <= len(d) <= 15 and len(set(d)) >= 4 else -1
            listed = 1 if span[0] in "+(" or (d[:1] == "0" and d[:3] != "000") else 0 if len(sizes) >= 3 else -1
        else:
            named, keyed = NAMED.match(span), KEYED.match(span) or BEGIN.match(span)
            value = span[named.start(1) :] if named else span
            form = 1 if named or keyed else -1
            check = 1 if _entropy(value[:4096]) >= 2.8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) else -1
            listed = 1 if keyed else 0
            announced = 1 if named or announced else 0 if keyed else -1
            edges = -1 if left and (left.isalnum() or left in "/_#.@-") or right and right in "/@" else 1
        return form, check, listed, announced, foreign, edges, min(4, len(span) // 8)


def _count(batches):
    """Rows (kind, votes, n) of a task."""
    finder = Finder()
    for batch in batches:
        total: dict[tuple, int] = {}
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            base = finder.base(text)
            for kind, s, e in [(KINDS[k], s, e) for s, k, e in base] + finder.proposed(text, base):
                key = (kind, ",".join(map(str, finder.votes(text, kind, s, e))))
                total[key] = total.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([v for _, v in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["kind", "votes", "n"])


def _count_pieces(batches):
    yield from _count(pieces(batches))


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation for one kind.

    votes: patterns by labelers in {-1, 0, 1}. Returns the probability that a
    pattern is personal data and each labeler's chances of its three votes,
    given that it is and given that it is not. Starts from the majority, in which context counts twice;
    counts are smoothed towards labelers that are right three times in four, and
    a labeler that would be wrong more often than right counts for nothing.
    """
    n = counts.astype(float)
    q = 1 / (1 + np.exp(-votes @ START[: votes.shape[1]]))
    prior = np.array([[1.0, 2.0, 3.0], [3.0, 2.0, 1.0]])  # votes -1, 0, 1, given yes and given no
    for _ in range(rounds):
        share = (n @ q + 1) / (n.sum() + 2)
        chance = np.empty((2, votes.shape[1], 3))
        for c, w in enumerate((n * q, n * (1 - q))):
            for v in (-1, 0, 1):
                chance[c, :, v + 1] = (w[:, None] * (votes == v)).sum(0) + prior[c, v + 1]
        chance /= chance.sum(2, keepdims=True)
        worse = np.flatnonzero(chance[0, :, 2] * chance[1, :, 0] < chance[1, :, 2] * chance[0, :, 0])
        chance[:, worse] = chance[:, worse].mean(0)
        logs = [np.log(s) + sum(np.log(chance[c, j, votes[:, j] + 1]) for j in range(votes.shape[1])) for c, s in ((0, share), (1, 1 - share))]
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
        if np.abs(new - q).max() < 1e-7:
            q = new
            break
        q = new
    return q, chance[0], chance[1]


def _features(votes: np.ndarray) -> np.ndarray:
    """Votes for, votes against, and the length class, one column each."""
    head, length = votes[:, : len(LABELERS)], votes[:, len(LABELERS)]
    return np.column_stack([head == 1, head == -1, *(length == i for i in range(5)), np.ones(len(votes))]).astype(float)


def train(patterns: list[tuple[str, str, int]]) -> dict[str, list[float]]:
    """Weights of the span classifier by kind, from counted vote patterns."""
    out = {}
    for kind in ALL_KINDS:
        rows = sorted((v, n) for k, v, n in patterns if k == kind)
        if not rows:
            continue
        votes = np.array([[int(x) for x in v.split(",")] for v, _ in rows])
        n = np.array([x for _, x in rows], float)
        y, _, _ = reliabilities(votes[:, : len(LABELERS)], n)
        x = _features(votes)
        # shares, each pattern at least as much as one in a thousand, so that rare ones teach too
        w, n = np.zeros(x.shape[1]), np.maximum(1000 * n / n.sum(), 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (n * (p - y)) + 0.1 * w)
            w = w - np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        out[kind] = w.tolist()
    return out


def _label(weights: dict[str, list[float]], threshold: float):
    def run(batches):
        finder, taken = Finder(), {}
        w = {k: np.array(v) for k, v in weights.items()}
        for batch in batches:
            base_out, all_out = [], []
            for text in batch.column("text").to_pylist():
                base = finder.base(text) if text else []
                spans = [(s, k, e, KINDS[k]) for s, k, e in base]
                for kind, s, e in finder.proposed(text, base) if text else ():
                    votes = finder.votes(text, kind, s, e)
                    if (kind, votes) not in taken:
                        score = float(_features(np.array([votes]))[0] @ w[kind]) if kind in w else -1e9
                        taken[kind, votes] = score >= np.log(threshold / (1 - threshold))
                    if taken[kind, votes]:
                        spans.append((s, ALL_KINDS.index(kind), e, kind))
                base_out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base])
                all_out.append([{"kind": kind, "start": s, "end": e} for s, _, e, kind in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text").cast(pa.string()), pa.array(base_out, SPANS), pa.array(all_out, SPANS)], names=["doc_id", "text", "base", "spans"])

    return run


def _weights(rows: DataFrame, count=_count) -> dict[str, list[float]]:
    counted = rows.select("text").mapInArrow(count, "kind string, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    return train([(r["kind"], r["votes"], r["n"]) for r in counted.collect()])


def find_pii(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """doc_id, text, base spans and all spans of every row, by start and then kind."""
    rows = docs.select(docs["doc_id"], docs["text"])
    return rows.mapInArrow(_label(_weights(rows), threshold), TAKEN)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans one replacement."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _redacted(weights: dict[str, list[float]], threshold: float, names: list[str]):
    label = _label(weights, threshold)

    def run(batches):
        at = []

        def texts():
            for batch in pieces(batches):
                at.append(batch)
                yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], names=["doc_id", "text"])

        for found in label(texts()):
            batch, spans = at.pop(), found.column("spans").to_pylist()
            text = [redact(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(batch.column("text").to_pylist(), spans)]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(text, batch.column("text").type)
            if "n_chars" in names:
                kind = batch.column("n_chars").type
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in text], pa.int64()).cast(kind)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def redact_pii(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The documents, with all their columns, every span replaced by its kind; n_chars, where there is one, follows."""
    return docs.mapInArrow(_redacted(_weights(docs.select(docs["text"]), _count_pieces), threshold, docs.columns), docs.schema)
