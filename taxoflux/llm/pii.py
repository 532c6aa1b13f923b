"""Operator 5: personal data by a semi-Markov conditional random field, beside fixed patterns.

Fixed patterns give base spans, which always stay.  The rest of a text is cut into zones of tokens
(runs of ASCII without spaces, quotes, commas, braces or the like) around digits and @ signs; there the field scores whole candidate segments (digit counts, checksums,
shape, separators, the word before) and a dynamic program over segments of at most MAX_TOKENS tokens
chooses boundaries and types together.  Types: the base kinds in other spellings (email with
"(at)" and "dot", telephone numbers without +, cards with other separators, IPv6).

The field's weights are fitted here, by gradient ascent on the exact likelihood of generated
sentences that hold such spans and look-alikes (dates, versions, prices, ids, keys); the generator and
its seed are parameters, no document is seen.  Texts are handled one by one, in linear time.

Defined cases: null or empty text has no span; long texts cost the length of their zones; repeated rows get
equal results; null ids are kept; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART, OVERLAP = 1_000, 64  # tokens of a zone that are read together, and those around them
KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 5
#: Longer segments are none of the kinds (an address of an email has at most 254 characters).
MAX_CHARS = 320
#: A segment is taken if the field gives it at least this share of all readings of its zone.
CERTAIN = 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no digit run is entered in its middle, so these find what the plain patterns find, in linear time
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]")
# white space, quotes, brackets, commas and other scripts end a token, as does the colon after a word
TOKEN = re.compile(r"""(?=[A-Fa-f]*+[G-Zg-z])[A-Za-z]++:|(?:\[(?:at|dot)\]|[^\x00-\x20,;"'`{}\[\]<>|=\x7F-\U0010FFFF])+""")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, sorted."""
    found = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGITS.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def zones(text: str, taken: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens around triggers outside base spans; tokens without their outer marks."""
    hot: list[list[tuple[int, int]]] = []
    end, k = -1, 0
    for m in TOKEN.finditer(text):
        trigger = TRIGGER.search(text, m.start(), m.end())
        if not trigger:
            continue
        start, stop = m.span()
        while k < len(taken) and taken[k][2] <= start:
            k += 1
        if k < len(taken) and taken[k][0] <= trigger.start() and taken[k][2] >= stop:
            continue
        if hot and start - end <= 1:
            hot[-1].append((start, stop))
        elif hot and start - end <= 6 and text[end:start].strip() in ("at", "dot", "(dot)", "[dot]"):
            hot[-1].append((end + 1, start - 1))
            hot[-1].append((start, stop))
        else:
            hot.append([(start, stop)])
        end = stop
    return [trimmed for zone in hot if (trimmed := [t for a, b in zone if (t := trim(text, a, b)) and not any(s < t[1] and t[0] < e for s, _, e in near(taken, t))])]


def near(taken, token):
    return [x for x in taken if x[0] < token[1] and token[0] < x[2]] if taken else ()


def trim(text: str, a: int, b: int) -> tuple[int, int] | None:
    while a < b and text[a] in ",.;:!?\"'#*$%&|<>":
        a += 1
    while a < b and text[b - 1] in ",.;:!?\"'#*$%&|<>":
        b -= 1
    return (a, b) if a < b else None


def shape(s: str) -> str:
    out = re.sub(r"[0-9]+", lambda m: f"{min(len(m[0]), 9)}", re.sub(r"[A-Za-z]+", "a", s))
    return out[:24]


def span_features(s: str, before: str, tokens: int) -> list[str]:
    """What a whole segment looks like."""
    digits = "".join(DIGITS.findall(s))
    rest = re.sub(r"[0-9]", "", s)
    letters = sum(c.isalpha() for c in rest)
    out = ["any", f"tokens={tokens}", f"digits={min(len(digits), 20)}", f"shape={shape(s)}", f"letters={min(letters, 3)}"]
    if set(rest) <= set(" ().-"):
        out.append(f"phone_like={10 <= len(digits) <= 15}")
        groups = re.findall(r"[0-9]+", s)
        out.append("groups=" + "-".join(str(len(g)) for g in groups[:6]))
        if 14 <= len(digits) <= 19 and set(rest) <= set(" .-"):
            out.append(f"luhn={luhn(digits)}:{len(digits)}")
    if re.fullmatch(r"[0-9a-fA-F:]+", s) and s.count(":") >= 4:
        out.append(f"hex_groups={min(s.count(':'), 8)}:{max(map(len, s.split(':'))) <= 4}")
    if re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(@|\(at\)|\[at\]) ?[A-Za-z0-9-]+( ?(\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+", s):
        out.append("spelled_email")
    if (word := before.strip(".,:;()\"'{}[]=").lower()) in ("tel", "phone", "call", "fax", "mobile", "card", "ip", "mail", "email"):
        out.append(f"before={word}")
    return out


def segments(text: str, zone: list[tuple[int, int]], tokens_before) -> dict[tuple[int, int], list[str]]:
    found = {}
    for i in range(len(zone)):
        for j in range(i + 1, min(len(zone), i + MAX_TOKENS) + 1):
            if zone[j - 1][1] - zone[i][0] > MAX_CHARS:
                break
            found[i, j] = span_features(text[zone[i][0] : zone[j - 1][1]], tokens_before(i), j - i)
    return found


def field(n: int, found: dict[tuple[int, int], list[str]], weights: dict[tuple[str, int], float]):
    """ln forward and backward sums, and (i, j, kind) -> score.  Outside tokens are segments of kind -1, score 0."""
    score = {(i, j, k): sum(weights.get((f, k), 0.0) for f in fs) for (i, j), fs in found.items() for k in range(len(KINDS))}
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    starts: dict[int, list] = {}
    for (i, j, k), s in score.items():
        starts.setdefault(i, []).append((j, s))
    for i in range(n):
        ahead[i + 1] = np.logaddexp(ahead[i + 1], ahead[i])
        for j, s in starts.get(i, ()):
            ahead[j] = np.logaddexp(ahead[j], ahead[i] + s)
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for j, s in starts.get(i, ()):
            behind[i] = np.logaddexp(behind[i], s + behind[j])
    return ahead, behind, score


def best_reading(n: int, score: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """The segmentation of highest score: (i, j, kind) of its entities."""
    best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
    by_end: dict[int, list] = {}
    for (i, j, k), s in score.items():
        by_end.setdefault(j, []).append((i, k, s))
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1], None
        for i, k, s in by_end.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, j, k)
    out, j = [], n
    while j:
        if back[j]:
            out.append(back[j])
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def sentences(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated training texts with their (start, kind, end) spans."""
    rng = np.random.default_rng(seed)
    d = lambda n: "".join(rng.choice(list("0123456789"), n))
    h = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    w = lambda: "".join(rng.choice(["th", "er", "an", "in", "on", "re", "st", "ou"], rng.integers(1, 4)))
    pick = lambda *x: x[rng.integers(len(x))]

    def card():
        sep = pick(".", "/", ".")
        body = d(15)
        last = next(c for c in "0123456789" if luhn(body + c))
        digits = body + last
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    email = lambda: pick(f"{w()}{pick('(at)', '[at]')}{w()}{pick('.', '(dot)', '[dot]')}com", f"{w()}.{d(2)}{pick('(at)', '[at]')}{w()}.org", f"{w()} {pick('(at)', '[at]')} {w()}.com")
    phone = lambda: pick(f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}")
    ip = lambda: ":".join(h(4) for _ in range(8))
    other = (
        lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(2)}.{d(2)}", lambda: d(int(rng.integers(1, 20))), lambda: h(40), lambda: h(32), lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(2)}:{d(2)}",
        lambda: f"{d(3)} {d(3)}", lambda: f"{w()}{d(2)}", lambda: f"{d(3)}-{d(2)}", lambda: f"{d(3)},{d(3)}", lambda: f"@{w()}", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(4)}.{d(4)}.{d(4)}.{d(3)}", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(3)}-{d(4)}", lambda: f"{w()}@{w()}",
        lambda: f"({d(4)})", lambda: f"({d(1)}) {d(2)}", lambda: f"{d(4)}/{d(2)}", lambda: f"{d(3)} {d(4)}",
    )
    out = []
    for _ in range(count):
        text, spans = w(), []
        for _ in range(rng.integers(1, 4)):
            text += " " + pick(w(), w(), "tel", "call", "no", "id")
            kind = int(rng.integers(-4, 4))
            s = other[rng.integers(len(other))]() if kind < 0 else (email, ip, card, phone)[kind]()
            if kind >= 0:
                spans.append((len(text) + 1, kind, len(text) + 1 + len(s)))
            text += " " + s + pick("", "", ",", ".") + " " + w()
        out.append((text, spans))
    return out


@lru_cache(maxsize=4)
def train(count: int = 400, rounds: int = 12, seed: int = 5) -> dict[tuple[str, int], float]:
    """Weights by adaptive gradient ascent on the semi-Markov likelihood, with a small pull to 0."""
    cases = []
    for text, spans in sentences(count, seed):
        for zone in zones(text, base_spans(text)):
            found = segments(text, zone, lambda i, z=zone, t=text: word_before(t, z[i][0]))
            gold = {(i, j, k) for i, j in found for s, k, e in spans if (zone[i][0], zone[j - 1][1]) == (s, e)}
            cases.append((len(zone), found, gold))
    weights: dict[tuple[str, int], float] = {}
    squares: dict[tuple[str, int], float] = {}
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for c in rng.permutation(len(cases)):
            n, found, gold = cases[c]
            ahead, behind, score = field(n, found, weights)
            gradient: dict[tuple[str, int], float] = {}
            for (i, j, k), s in score.items():
                pull = ((i, j, k) in gold) - float(np.exp(ahead[i] + s + behind[j] - ahead[n]))
                if abs(pull) > 1e-4:
                    for f in found[i, j]:
                        gradient[f, k] = gradient.get((f, k), 0.0) + pull
            for f, g in gradient.items():
                g -= 0.002 * weights.get(f, 0.0)
                squares[f] = squares.get(f, 1e-2) + g * g
                weights[f] = weights.get(f, 0.0) + 0.5 * g / squares[f] ** 0.5
    return weights


def word_before(text: str, start: int) -> str:
    return text[max(0, start - 14) : start].rsplit(None, 1)[-1] if text[max(0, start - 14) : start].strip() else ""


def find(text: str, weights: dict[tuple[str, int], float], certain: float = CERTAIN) -> tuple[list, list]:
    """(base spans, base and added spans): (start, kind, end) sorted."""
    if not text or not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    added, last = [], 0
    for whole in zones(text, base):
        for zone, first, stop in parts(whole):
            found = segments(text, zone, lambda i: word_before(text, zone[i][0]))
            ahead, behind, score = field(len(zone), found, weights)
            for i, j, k in best_reading(len(zone), score):
                if first <= i < stop and zone[i][0] >= last and np.exp(ahead[i] + score[i, j, k] + behind[j] - ahead[-1]) >= certain and not near(base, (zone[i][0], zone[j - 1][1])):
                    added.append((zone[i][0], k, zone[j - 1][1]))
                    last = zone[j - 1][1]
    return base, sorted(base + added)


def parts(zone: list) -> list[tuple[list, int, int]]:
    """A long zone in parts that overlap: (tokens, first, stop), segments that begin at first <= i < stop are taken from it.
    What is more than OVERLAP tokens away has no bearing on a segment, and memory follows PART, not the text."""
    if len(zone) <= PART:
        return [(zone, 0, len(zone))]
    out = []
    for a in range(0, len(zone), PART):
        low, high = max(0, a - OVERLAP), min(len(zone), a + PART + OVERLAP)
        out.append((zone[low:high], a - low, min(a + PART, len(zone)) - low))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def finder(weights):
    """Batches with a text column -> the same rows with base and all spans as strings."""

    def run(batches):
        known = weights.value
        for batch in batches:
            base, every = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                b, e = find(text, known)
                base.append(b)
                every.append(joined(e))
            columns = [*(c for c, name in zip(batch.columns, batch.schema.names) if name != "text")]
            counts = [pa.array([sum(k == i for _, k, _ in b) for b in base], pa.int64()) for i in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
            names = [*(x for x in batch.schema.names if x != "text"), *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([*columns, *counts, digest, pa.array(every, pa.string())], names=names)

    return run


def detect(docs: DataFrame, **training) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans."""
    weights = docs.sparkSession.sparkContext.broadcast(train(**training))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(finder(weights), f"doc_id long, {counts}, base_sha256 string, spans string")


def masker(weights):
    """Batches -> the same rows with every span of text replaced by its kind in brackets."""

    def run(batches):
        known = weights.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text in batch.column(at).to_pylist():
                if text:
                    parts, last = [], 0
                    for a, k, b in find(text, known)[1]:
                        if b <= last:
                            continue
                        if a >= last:
                            parts += [text[last:a], f"[{KINDS[k].upper()}]"]
                        last = b
                    text = "".join(parts) + text[last:]
                texts.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return run


def mask(docs: DataFrame, **training) -> DataFrame:
    """The same rows and columns, with personal data in text replaced by [EMAIL], [IP], [CARD] or [PHONE];
    a column n_chars, if there is one, follows the text."""
    weights = docs.sparkSession.sparkContext.broadcast(train(**training))
    masked = docs.mapInArrow(masker(weights), docs.schema)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return masked
