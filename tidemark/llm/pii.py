"""Personal data by a semi-Markov conditional random field over whole spans.

Base spans follow fixed patterns and always stay. The field reads regions of the text: candidate segments of up to
MOST_TOKENS tokens that have the outline of a kind are scored by features of the whole span and its neighbourhood,
everything else is a segment of one token with score 0, and one dynamic program picks boundaries and kinds together.
Regions are the runs of signs that an outline needs (see ``regions``), in whole tokens, and features look beyond them.
Outside the regions no segment has the outline of a kind, so the best labelling of the text is that of its regions.
Spans of the field are added where they touch no base span.

The weights are fitted here, by gradient ascent on the exact conditional likelihood (forward and backward sums over the
segment lattice), on sentences that a seeded generator writes: no table is needed, so the model is the same at any size.

Defined cases: a null text is empty and has no spans; an empty table gives no rows; repeated rows are searched each;
other columns pass through ``find`` and ``redact``.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
MOST_TOKENS = 22

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base kinds' matches, leftmost and non-overlapping within a kind, in order of start and kind."""
    out: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            last = m.end()
            out.append((start, last, "email"))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((*m.span(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return out


# --- the field -----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+|\s+|.", re.S)
#: What any segment with an outline lies in. Numbers: cards, phones, plain addresses; a pattern a spelling of '@', each with the domain ahead.
_NUMBER = re.compile(r"\d[\d ().-]{6,}+")
_PARTED = re.compile(r"(?<!\d)\d++(?:(?:\.|\[\.\]|\(\.\)| \. )\d++){3,}+")
_LONG_RUN = re.compile(r"(?<![\w+/=-])[\w+/=-]{16,}+")
_DOTTED = rf"[\w-]++(?:(?:\.| ?[\[(]dot[\])] ?| dot )[\w-]++){{1,{MOST_TOKENS}}}"
_ATS = (re.compile(rf"@(?=({_DOTTED}))"), re.compile(rf" at(?= ({_DOTTED}))"), re.compile(rf"[\[(]at(?=[\])] ?({_DOTTED}))"))
_DIGIT, _LETTER = re.compile(r"\d"), re.compile("[A-Za-z]")
#: Outlines: what a segment of each kind looks like at least.
_OUTLINE = {
    "email": re.compile(r"[\w.%+-]++(?:@| ?[\[(]at[\])] ?| at )[\w-]+(?:(?:\.| ?[\[(]dot[\])] ?| dot )[\w-]+)+"),
    "ip": re.compile(r"\d{1,3}(?:(?:\.|\[\.\]|\(\.\)| \. )\d{1,3}){3}"),
    "card": re.compile(r"\d(?:[ .-]{0,2}\d){11,18}"),
    "phone": re.compile(r"(?:\+|00|\()?\d[\d ().-]{5,18}\d"),
    "secret": re.compile(r"(?=[^\d]*\d)(?=[^A-Za-z]*[A-Za-z])[\w+/=-]{16,}"),
}
#: Words that announce a kind.
_CUES = {
    "email": frozenset("mail email e-mail contact write reach courriel correo".split()),
    "ip": frozenset("ip host server address addr node from login".split()),
    "card": frozenset("card visa mastercard amex credit debit cc payment karte tarjeta carte".split()),
    "phone": frozenset("phone tel call mobile fax cell telefon telefono téléphone whatsapp".split()),
    "secret": frozenset("password passwd pwd token secret key apikey api_key pass credential".split()),
    "none": frozenset("page pages version isbn order invoice item date no number id year total chapter vol".split()),
}
_WORD = re.compile(r"[^\W\d_]+(?:[-_][^\W\d_]+)?")


def span_features(kind: str, text: str, start: int, end: int, cue: str) -> list[str]:
    """Names of the features that hold for text[start:end] as one span of the kind."""
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    n = len(digits)
    before, after = text[start - 1 : start], text[end : end + 1]
    out = ["bias", f"cue={cue if cue in (kind, 'none', '') else 'other'}"]
    if before and (before.isalnum() or before in "._-/+@"):
        out.append("joined-left")
    if after and (after.isalnum() or after in "_-/@") or after == "." and text[end + 1 : end + 2].isalnum():
        out.append("joined-right")
    if before in ("=", '"', "'"):
        out.append("given")
    if kind == "card":
        out += [f"luhn={luhn(digits)}", f"digits={n if n in (13, 14, 15, 16, 19) else 0}", f"even={len({len(p) for p in re.split(r'[ .-]+', s)}) <= 2}"]
    elif kind == "phone":
        out += [f"digits={n if n < 8 else 8 if n < 10 else 10 if n < 12 else 12 if n < 16 else 16}", f"plus={s[0] == '+'}", f"bracket={'(' in s}", f"parts={min(len(re.findall(r'[0-9]+', s)), 5)}", f"gaps={'  ' in s or '--' in s}"]
        if re.fullmatch(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{2,4}", s):
            out.append("date")
        if s.count("(") != s.count(")"):
            out.append("open")
        if n >= 12 and luhn(digits):
            out.append("luhn")
        if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", s):
            out.append("dotted")
    elif kind == "ip":
        out += [f"bytes={all(int(p) <= 255 for p in re.findall('[0-9]+', s))}", f"plain={'[' not in s and ' ' not in s}"]
    elif kind == "email":
        out += [f"at={'@' in s}", f"end={bool(re.search(r'(?:com|org|net|edu|de|fr|es|io|info)$', s))}"]
    else:
        upper, lower = bool(re.search("[A-Z]", s)), bool(re.search("[a-z]", s))
        out += [f"size={min(len(s) // 8, 5)}", f"case={upper}{lower}", f"hex={bool(re.fullmatch('[0-9a-f]+', s))}", f"share={min(int(5 * n / len(s)), 4)}", f"known={bool(re.match('AKIA|ASIA|ghp_|sk-|xox', s))}"]
    return [f"{kind}|{x}" for x in out]


def _nearest_cue(text: str, start: int) -> str:
    words = _WORD.findall(text[max(0, start - 32) : start])[-3:]
    for w in reversed(words):
        w = w.lower()
        for kind, known in _CUES.items():
            if w in known or (len(w) > 4 and w.rstrip("s:") in known):
                return kind
    return ""


def lattice(text: str, start: int = 0, end: int | None = None) -> tuple[list[int], list[tuple[int, int, str, list[str]]]]:
    """Token edges from start to end, and the candidate segments (first token, token after the last, kind, features)."""
    edges = [start, *(m.end() for m in _TOKEN.finditer(text, start, len(text) if end is None else end))]
    n = len(edges) - 1
    found = []
    for i in range(n):
        c = text[edges[i]]
        if c.isspace() or not (c.isalnum() or c in "+(_"):
            continue
        cue = None
        for j in range(i + 1, min(i + MOST_TOKENS, n) + 1):
            last = text[edges[j] - 1]
            if last.isspace() or not (last.isalnum() or last in "_="):
                continue
            for kind, outline in _OUTLINE.items():
                if outline.fullmatch(text, edges[i], edges[j]):
                    if cue is None:
                        cue = _nearest_cue(text, edges[i])
                    found.append((i, j, kind, span_features(kind, text, edges[i], edges[j], cue)))
    return edges, found


def _sums(n: int, found: list, scores: list[float]) -> tuple[list[float], list[float]]:
    """Logarithms of the forward and backward sums at each token edge."""
    by_end: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    by_start: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for (i, j, *_), s in zip(found, scores, strict=True):
        by_end[j].append((i, s))
        by_start[i].append((j, s))

    def total(xs):
        top = max(xs)
        return top + math.log(sum(math.exp(x - top) for x in xs))

    ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = total([ahead[j - 1], *(ahead[i] + s for i, s in by_end[j])])
    for i in range(n - 1, -1, -1):
        back[i] = total([back[i + 1], *(back[j] + s for j, s in by_start[i])])
    return ahead, back


def decode(text: str, weights: dict[str, float], start: int = 0, end: int | None = None) -> list[Span]:
    """The best segmentation of a region."""
    edges, found = lattice(text, start, end)
    if not found:
        return []
    n = len(edges) - 1
    by_end: dict[int, list] = {}
    for i, j, kind, names in found:
        s = sum(weights.get(x, 0.0) for x in names)
        if s > 0:  # a segment below the score of leaving its tokens out is never on the best path
            by_end.setdefault(j, []).append((i, kind, s))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, kind, s in by_end.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, kind)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((edges[i], edges[j], kind))
            j = i
    return out[::-1]


def _sentence(r: random.Random) -> tuple[str, list[Span]]:
    """Invented words with personal data, and with numbers that are none."""
    word = lambda: "".join(r.choice(["an", "er", "la", "que", "ti", "on", "sch", "re", "do", "eau"]) for _ in range(r.randint(1, 3)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    parts: list[tuple[str, str]] = []

    def card():
        d = r.choice("3456") + num(r.choice([11, 14, 14, 14]))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {num(2)} {num(4)} {num(4)}", f"{a}.{b}.{c}", f"+{num(2)}{num(9)}", f"00{num(2)} {num(3)} {num(6)}"])

    def email():
        a, b = f"{word()}.{num(2)}" if r.random() < 0.5 else word(), r.choice(["example.com", "mail3.example.org", f"{word()}.net"])
        return r.choice([f"{a}@{b}", f"{a}@{b}", f"{a} at {b.replace('.', ' dot ')}", f"{a} [at] {b.replace('.', ' [dot] ')}", f"{a}(at){b.replace('.', '(dot)')}"])

    def ip():
        d = [str(r.randint(1, 254)) for _ in range(4)]
        return r.choice([".".join(d), ".".join(d), "[.]".join(d), "(.)".join(d)])

    def secret():
        return r.choice(
            ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 24, 32, 40]))), "sk-" + "".join(r.choice("abcdefghABCDEFGH0123456789") for _ in range(32))]
        )

    def plain():
        return r.choice(
            [f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", num(r.randint(1, 8)), f"{num(2)}:{num(2)}:{num(2)}",
             f"${num(3)}.{num(2)}", f"{num(4)}-{num(4)}", f"isbn 978-{num(1)}-{num(5)}-{num(3)}-{num(1)}", f"{num(3)} {num(3)}", f"order {num(10)}", f"{num(3)}.{num(3)}.{num(3)}.{r.randint(300, 999)}", f"id {num(16)}", f"page {num(3)}-{num(3)}", word() + num(3), word() * 6, f"{num(1)}, {num(1)}, {num(2)}"]
        )

    make = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}
    for _ in range(r.randint(2, 5)):
        parts += [(word(), "") for _ in range(r.randint(1, 4))]
        kind = r.choice([*KINDS, "", ""])
        if not kind:
            parts.append((plain(), ""))
            continue
        if r.random() < 0.5 or kind == "secret" and r.random() < 0.7:
            parts.append((r.choice(sorted(_CUES[kind])) + r.choice(["", ":", " =", " is"]), ""))
        s = make[kind]()
        if kind == "secret" and r.random() < 0.4:
            parts.append((f'{r.choice(["password=", "token=", "key="])}\0{s}', kind))
        elif kind == "secret" and r.random() < 0.4:
            parts.append((f'token = "\0{s}\0"', kind))
        else:
            parts.append((s, kind))
    parts.append((word() + ".", ""))
    text, spans = "", []
    for s, kind in parts:
        if text:
            text += " "
        lead, _, rest = s.partition("\0") if "\0" in s else ("", "", s)
        body, _, tail = rest.partition("\0")
        text += lead
        if kind:
            spans.append((len(text), len(text) + len(body), kind))
        text += body + tail
    return text, spans


@functools.cache
def model(sentences: int = 500, rounds: int = 6, seed: int = 7) -> dict[str, float]:
    """Weights by feature, fitted on the generator's sentences. Takes a few seconds, once a process."""
    r = random.Random(seed)
    cases = []
    for _ in range(sentences):
        text, spans = _sentence(r)
        edges, found = lattice(text)
        gold = set(spans)
        hit = [(edges[i], edges[j], kind) in gold for i, j, kind, _ in found]
        cases.append((len(edges) - 1, found, hit))
    weights: dict[str, float] = {}
    seen: dict[str, float] = {}
    for _ in range(rounds):
        for n, found, hit in cases:
            scores = [sum(weights.get(x, 0.0) for x in names) for *_, names in found]
            ahead, back = _sums(n, found, scores)
            grad: dict[str, float] = {}
            for (i, j, _, names), s, h in zip(found, scores, hit, strict=True):
                p = math.exp(ahead[i] + s + back[j] - ahead[n])
                if abs(h - p) > 1e-4:
                    for x in names:
                        grad[x] = grad.get(x, 0.0) + h - p
            for x, g in grad.items():
                g -= 0.002 * weights.get(x, 0.0)
                seen[x] = seen.get(x, 1e-2) + g * g
                weights[x] = weights.get(x, 0.0) + 0.5 * g / math.sqrt(seen[x])
    return weights


def regions(text: str) -> list[tuple[int, int]]:
    """Where a segment can have an outline: the longest runs of each kind's signs, in whole tokens, merged.

    Digits with what may stand between them hold cards, phones and plain addresses; four numbers with dots of any
    spelling the other addresses; runs of 16 signs with a digit and a letter the secrets; and a spelled '@' before a
    dotted name, with the signs to its left, the mail addresses.
    """
    found, n = [], len(text)
    for m in _NUMBER.finditer(text):
        a, b = m.start(), m.end()
        while not text[b - 1].isdecimal():
            b -= 1
        if b - a >= 7:
            found.append((a - (text[a - 1 : a] in ("+", "(")), b))
    if "[.]" in text or "(.)" in text or " . " in text:
        found += [m.span() for m in _PARTED.finditer(text)]
    found += [m.span() for m in _LONG_RUN.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]
    for at in _ATS:
        for m in at.finditer(text):
            a = m.start()
            if m[0][0] in "[(" and text[a - 1 : a] == " ":
                a -= 1
            while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_.%+-"):
                a -= 1
            found.append((a, m.end(1)))
    found.sort()
    out: list[list[int]] = []
    for a, b in found:
        if out and b <= out[-1][1]:
            continue
        while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < n and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = [min(a, out[-1][0]), max(out[-1][1], b)]
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def all_spans(text: str, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the field's, in order."""
    base = base_spans(text)
    out = list(base)
    taken = sorted((a, b) for a, b, _ in base)
    for a, b in regions(text):
        for s, e, kind in decode(text, weights, a, b):
            if not any(x < e and s < y for x, y in taken if x < e):
                out.append((s, e, kind))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return base, out


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """docs with ``pii``: array of (start, end, kind, base), offsets in code points."""
    weights = model()
    kept = docs.drop("pii")
    schema = T.StructType([*kept.schema.fields, T.StructField("pii", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())])))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(text or "", weights)
                held = set(base)
                rows.append([{"start": a, "end": b, "kind": k, "base": (a, b, k) in held} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "pii"])

    return kept.mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in ``text`` replaced, and ``n_chars``, where there is one, counted anew."""
    weights = model()

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = [None if t is None else redacted(t, all_spans(t, weights)[1]) for t in batch.column("text").to_pylist()]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.select(*[F.coalesce(F.length("text").cast(kind), F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])
    return out


_DIGEST = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64())])


def digests(docs: DataFrame) -> DataFrame:
    weights = model()

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, spans = all_spans(text or "", weights)
                row = {"doc_id": doc_id, "base_sha256": hashlib.sha256(written(base).encode()).hexdigest(), "spans": written(spans), "n_secret": sum(s[2] == "secret" for s in spans)}
                rows.append(row | {f"n_{k}": sum(s[2] == k for s in base) for k in BASE_KINDS})
            yield pa.RecordBatch.from_pylist(rows, _DIGEST)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spread(table(spark, sf_dir, "documents")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced in every text."""
    return redact(docs)
