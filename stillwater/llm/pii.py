"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans to theirs.

The base takes four kinds by pattern (email, ip, card, phone), each with its check. The random field then looks
at the regions of a text that can hold personal data at all: runs of digits and separators, spelled-out or
plain addresses, long mixed tokens. It scores candidate segments of at most LONGEST tokens as a whole: shape,
number of digits, check digits, octets, brackets, the word before, the characters around. A dynamic program over
segments chooses boundaries and kinds together. Its weights maximise the likelihood of generated sentences (a
fixed generator and seed), with gradients from the forward and backward sums over all segmentations.

All offsets are code points, ends exclusive. Added spans never overlap base ones, which stay as they are.

Defined cases: a null or empty text has no spans; a text is taken whole, however long, and a region or run of any
length costs time in proportion; repeated rows, null ids and other columns pass through; columns of the input
that are named like results give way; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stillwater.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LONGEST = 24
MOST_KNOWN = 20_000

# --------------------------------------------------------------------------- base patterns

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where its run of digits starts, so the look-behind loses none and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            low = m.end()
        else:
            low = max(low, at + 1)
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return out


# --------------------------------------------------------------------------- segments

_REGION = re.compile(
    r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().\-/]{0,3}+[0-9]){6,}+"  # digits and separators
    r"|[A-Za-z0-9._%+-]{1,64}+ ?(?:[\[(]at[\])]|@| at ) ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.| dot ) ?[A-Za-z0-9-]++)++"  # addresses, spelled out or not
    r"|(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+"  # long tokens with a digit
)
_MAY = re.compile(r"[0-9]|\bat\b|\(at\)|\[at\]|@")
_TOKEN = re.compile(r"[A-Za-z0-9_%]+|\s|.", re.S)
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$")
_CUES = {
    "phone": "phone tel telephone call fax mobile cell whatsapp sms dial ring".split(),
    "card": "card visa mastercard amex credit debit cc payment".split(),
    "email": "email mail contact write reach e".split(),
    "ip": "ip host address server from".split(),
    "secret": "token secret key password passwd api bearer apikey credential pwd".split(),
    "number": "order invoice no number isbn ref id version page pages date on year doi article chapter section sum total".split(),
}
_CUE = {w: k for k, ws in _CUES.items() for w in ws}
_AT = re.compile(r"@|\bat\b", re.I)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}.*|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}.*")


def regions(text: str) -> Iterator[tuple[int, int]]:
    if _MAY.search(text):
        for m in _REGION.finditer(text):
            yield m.span()


def _shape(span: str) -> str:
    """Runs of digits and letters as one sign each, at most twelve signs."""
    return re.sub(r"[A-Za-z_%]+", "a", re.sub(r"[0-9]+", "d", span))[:12]


def span_features(text: str, start: int, end: int) -> list[str]:
    """What a whole span looks like, and what stands around it."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    before = _WORD_BEFORE.search(text, max(0, start - 24), start)
    left, right = text[start - 1 : start], text[end : end + 1]
    letters = sum(c.isalpha() for c in span)
    out = ["bias", f"shape={_shape(span)}", f"digits={min(len(digits), 24)}", f"cue={_CUE.get(before[1].lower(), 'other') if before else 'none'}"]
    out.append(f"left={'d' if left.isdigit() else 'a' if left.isalpha() else left if left in '+.-/@_(' and left else '_'}")
    out.append(f"right={'d' if right.isdigit() else 'a' if right.isalpha() else right if right in '.-/@_)' and right and not text[end + 1 : end + 2].isspace() else '_'}")
    if not letters:
        if 13 <= len(digits) <= 19:
            out.append(f"luhn={luhn(digits)}")
        parts = span.split(".")
        if len(parts) == 4 and all(p.isdigit() for p in parts):
            out.append(f"octets={all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
        if 7 <= len(digits) <= 15:
            out.append(f"call={span[0] in '+('}{any(c in span for c in '() -./')}")
        if _DATE.fullmatch(span):
            out.append("date")
        if span.count("(") != span.count(")"):
            out.append("unbalanced")
    elif _AT.search(span):
        out += ["at", f"dots={min(3, len(re.findall(r'[.]|dot', span)))}", f"tail={bool(re.search(r'[A-Za-z]{2,}$', span))}", f"spelled={'@' not in span}{bool(re.search('dot', span))}{'(' in span or '[' in span}"]
    else:
        hexes = all(c in "0123456789abcdefABCDEF-" for c in span)
        out += [f"long={min(6, len(span) // 8)}", f"hex={hexes}", f"mixed={min(4, len(digits) * 8 // max(1, len(span)))}"]
    return out


def segments_from(text: str, bounds: Sequence[int], i: int) -> Iterator[tuple[int, list[str]]]:
    """(end token, features) of the segments that begin with token i: of at most LONGEST tokens and at least 7 characters,
    that begin and end with a letter, a digit, "_", or at the front a sign like "+" or "("."""
    begin = bounds[i]
    if text[begin].isspace() or text[begin] in ").-/":
        return
    for j in range(i + 1, min(len(bounds), i + LONGEST + 1)):
        last = text[bounds[j] - 1]
        if (last.isalnum() or last == "_") and bounds[j] - begin >= 7:
            yield j, span_features(text, begin, bounds[j])


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """A region's token bounds, and all its segments (first token, end token, features) at once: for training."""
    bounds = [m.start() for m in _TOKEN.finditer(text, start, end)] + [end]
    return bounds, [(i, j, names) for i in range(len(bounds) - 1) for j, names in segments_from(text, bounds, i)]


class Field:
    """Weights (kinds x features), a score for each token outside, and the sums over segmentations."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((len(KINDS), 0))
        self.outside = 0.0
        self.known: dict[tuple[str, ...], tuple[float, int]] = {}  # results of best(), at most MOST_KNOWN

    def scores(self, segments: list[tuple[int, int, list[str]]]) -> np.ndarray:
        out = np.zeros((len(KINDS), len(segments)))
        for s, (_, _, names) in enumerate(segments):
            known = [self.index[x] for x in names if x in self.index]
            out[:, s] = self.weights[:, known].sum(1) if known else -8.0
        return out

    def best(self, names: tuple[str, ...]) -> tuple[float, int]:
        """The score of a segment with these features under its best kind, and that kind's number."""
        if (found := self.known.get(names)) is None:
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            scores = self.scores([(0, 0, names)])[:, 0]
            found = self.known[names] = float(scores.max()), int(scores.argmax())
        return found

    def decode(self, text: str, start: int, end: int) -> list[tuple[str, int, int]]:
        """The best segmentation of a region. A segment is scored when its first token is reached and then let go, so that
        only three numbers for each token stay."""
        bounds = array("q", (m.start() for m in _TOKEN.finditer(text, start, end)))
        bounds.append(end)
        n = len(bounds) - 1
        value, back, kinds = array("d", [-np.inf]) * (n + 1), array("q", [-1]) * (n + 1), bytearray(n + 1)
        value[0] = 0.0
        for i in range(n):
            here = value[i]
            if here + self.outside >= value[i + 1]:
                value[i + 1], back[i + 1] = here + self.outside, -1
            for j, names in segments_from(text, bounds, i):
                score, kind = self.best(tuple(names))
                if here + score > value[j]:
                    value[j], back[j], kinds[j] = here + score, i, kind
        out, j = [], n
        while j > 0:
            if back[j] >= 0:
                out.append((KINDS[kinds[j]], bounds[back[j]], bounds[j]))
                j = back[j]
            else:
                j -= 1
        return out[::-1]

    def expectations(self, n: int, segments, scores: np.ndarray) -> tuple[np.ndarray, float]:
        """The probability of each (kind, segment), and the expected number of tokens outside."""
        by_end: dict[int, list[int]] = {}
        by_begin: dict[int, list[int]] = {}
        for s, (i, j, _) in enumerate(segments):
            by_end.setdefault(j, []).append(s)
            by_begin.setdefault(i, []).append(s)
        total = np.logaddexp.reduce(scores, 0) if len(segments) else np.zeros(0)
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1] + self.outside, *(forward[segments[s][0]] + total[s] for s in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1] + self.outside, *(backward[segments[s][1]] + total[s] for s in by_begin.get(i, ()))])
        p = np.zeros_like(scores)
        for s, (i, j, _) in enumerate(segments):
            p[:, s] = np.exp(forward[i] + scores[:, s] + backward[j] - forward[n])
        out = sum(np.exp(forward[j - 1] + self.outside + backward[j] - forward[n]) for j in range(1, n + 1))
        return p, float(out)

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 12, rate: float = 0.15, decay: float = 1e-3) -> Field:
        """examples: texts and their spans. Gradient steps on the log-likelihood of each region's segmentation."""
        made = []
        for text, spans in examples:
            for start, end in regions(text):
                bounds, segments = candidates(text, start, end)
                place = {b: i for i, b in enumerate(bounds)}
                gold = {(place[a], place[b]): KINDS.index(k) for k, a, b in spans if a in place and b in place}
                for _, _, names in segments:
                    for x in names:
                        self.index.setdefault(x, len(self.index))
                made.append((len(bounds) - 1, segments, gold))
        self.weights = np.zeros((len(KINDS), len(self.index)))
        draw = np.random.default_rng(2)
        ids = [[[self.index[x] for x in names] for _, _, names in segments] for _, segments, _ in made]
        for epoch in range(epochs):
            step = rate / (1 + epoch / 4)
            for r in draw.permutation(len(made)).tolist():
                n, segments, gold = made[r]
                scores = np.stack([self.weights[:, f].sum(1) for f in ids[r]], 1) if segments else np.zeros((len(KINDS), 0))
                p, out = self.expectations(n, segments, scores)
                covered = 0
                for s, (i, j, _) in enumerate(segments):
                    g = -p[:, s]
                    if (i, j) in gold:
                        g[gold[i, j]] += 1
                        covered += j - i
                    if np.abs(g).max() > 1e-4:
                        self.weights[:, ids[r][s]] += step * g[:, None]
                self.outside += step * ((n - covered) - out) / max(1, n)
            self.weights *= 1 - decay
        return self


def examples(count: int = 700, seed: int = 4) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated sentences with spans of each kind in several notations, and numbers that are none."""
    draw = np.random.default_rng(seed)
    pick = lambda xs: xs[int(draw.integers(len(xs)))]
    ds = lambda k: "".join(str(x) for x in draw.integers(0, 10, k))
    word = lambda: "".join(pick("abcdefghiklmnoprstuvw") for _ in range(int(draw.integers(3, 9))))

    def card() -> str:
        body = pick("3456") + ds(14)
        digits = next(body + str(x) for x in range(10) if luhn(body + str(x)))
        sep = pick([" ", "-", "", "."])
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = str(int(draw.integers(2, 10))) + ds(2), ds(3), ds(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{pick('134')}{ds(1)} {a} {b} {c}", f"00{pick('134')}{ds(1)} {a} {b} {c}"])

    def email() -> str:
        user, host, end = f"{word()}{pick(['.', '_', ''])}{word()}", f"{pick(['mail', word()])}{pick(['', ds(1)])}", pick(["com", "org", "example.com", "net", "de"])
        dotted = end.replace(".", " dot ")
        return pick([f"{user}@{host}.{end}", f"{user} at {host} dot {dotted}", f"{user} (at) {host}.{end}", f"{user}[at]{host}.{end}", f"{user} [at] {host} [dot] {pick(['com', 'org'])}"])

    makers = {
        "card": card, "phone": phone, "email": email,
        "ip": lambda: ".".join(str(x) for x in draw.integers(0, 256, 4)),
        "secret": lambda: pick([hashlib.sha256(ds(9).encode()).hexdigest()[: int(pick([32, 40, 64]))], "sk_live_" + hashlib.md5(ds(9).encode()).hexdigest()[:24], "AKIA" + hashlib.md5(ds(9).encode()).hexdigest()[:16].upper()]),
    }
    others = [
        lambda: f"20{ds(2)}-0{pick('123456789')}-1{ds(1)}", lambda: f"20{ds(2)}-0{pick('123456789')}-1{ds(1)} 1{ds(1)}:{ds(2)}", lambda: ds(int(draw.integers(7, 13))), lambda: f"{ds(3)}.{ds(3)}.{ds(3)}",
        lambda: f"978-{ds(1)}-{ds(4)}-{ds(4)}-{ds(1)}", lambda: f"10.{ds(4)}/{ds(6)}", lambda: f"{ds(2)}.{ds(2)}.20{ds(2)}", lambda: f"{word()} at {word()}.", lambda: ds(16), lambda: f"{ds(4)} {ds(4)} {ds(4)}",
        lambda: f"3{ds(2)}.{ds(3)}.9{ds(2)}.8{ds(2)}", lambda: f"{word()}-{word()}-{word()}-{word()}-{ds(1)}", lambda: f"{ds(4)}-{ds(4)}", lambda: f"{word()} at {word()}. {word().title()} dot",
    ]
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(int(draw.integers(1, 5)))) + " ", []
        for _ in range(int(draw.integers(1, 3))):
            if draw.random() < 0.62:
                kind = pick(KINDS)
                if draw.random() < 0.5:
                    text += pick(_CUES[kind]) + pick([": ", " ", " = "])
                value = makers[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += (pick(_CUES["number"]) + " " if draw.random() < 0.5 else "") + pick(others)()
            text += pick([". ", " ", ", "]) + " ".join(word() for _ in range(int(draw.integers(1, 4)))) + " "
        out.append((text, spans))
    return out


@functools.cache
def trained() -> Field:
    return Field().fit(examples())


# --------------------------------------------------------------------------- documents


def all_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """base and what the field adds, by kind, then start."""
    added: list[tuple[str, int, int]] = []
    taken: list[list[int]] = []  # stretches that base spans cover
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    at = 0  # the first stretch that ends behind the spans seen so far; these come in order
    for start, end in regions(text):
        for kind, a, b in field.decode(text, start, end):
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if at == len(taken) or b <= taken[at][0]:
                added.append((kind, a, b))
    return sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if added else base


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch that spans cover written as [KIND] of its first span."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


RESULTS = {"n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string", "n_added": "bigint", "masked": "string"}


def find(documents: DataFrame, text: str = "text", want: tuple[str, ...] = tuple(RESULTS)) -> DataFrame:
    """documents (but for columns named like results) and the wanted results of its text column."""
    kept = [c for c in documents.columns if c not in RESULTS or c == text]
    source = documents.select(*[documents[f"`{c}`"] for c in kept])
    place = kept.index(text)
    field = documents.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text, 4_000_000):
            columns: dict[str, list] = {c: [] for c in want}
            for x in part.column(place).to_pylist():
                value = x or ""
                base = base_spans(value)
                spans = all_spans(value, base, field.value)
                got = {f"n_{k}": sum(s[0] == k for s in base) for k in BASE} | {"base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(spans), "n_added": len(spans) - len(base)}
                if "masked" in columns:
                    got["masked"] = None if x is None else masked(value, spans) if spans else x
                for c in want:
                    columns[c].append(got[c])
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(columns[c], pa.int64() if RESULTS[c] == "bigint" else pa.string()) for c in want)], names=[*kept, *want])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in source.schema), *(f"{c} {RESULTS[c]}" for c in want)])
    return common.map_batches(source, run, schema)
