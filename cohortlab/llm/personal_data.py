"""Personal data: base patterns plus a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) are matched over whole texts.  The model
scores whole candidate spans of up to ``MAX_TOKENS`` tokens and ``MAX_CHARS`` characters, and
credentials (a cue word and its whole value) of any length, with features of the
span (its characters, digit counts, checksum, neighbours, cue words) and a
transition score between neighbouring spans; a dynamic program over start, end and
type picks the best segmentation of every window, which fixes boundaries and types
jointly.  Spans it finds away from base spans are added.

A window is a run of space-separated chunks that hold a digit, ``@`` or a cue word
with ``=`` or ``:`` (and what follows it: ``token = "..."`` is in one window); a span
without any is no candidate, so text outside the windows is the background type and
the windows can be solved one by one without changing the result.

The model is fitted by gradient ascent on the conditional likelihood of at most
``WINDOWS`` windows of about ``SAMPLE`` sampled documents (documented bounds), labelled
with the base patterns and two credential patterns.  Windows with a credential are
rare, so they come first, up to a quarter of the windows, from all documents.

Defined results: NULL and empty texts have no spans; repeated rows are treated
alike; very long texts are scanned whole in linear time; an empty table gives an
empty result and a model of zero weights; other columns pass through untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm.common import stage

# fixed order: the kinds of the base patterns, then those only the model finds
KINDS = ["email", "ip", "card", "phone", "key", "secret"]
MAX_TOKENS = 16
MAX_CHARS = 80
SAMPLE = 6000
WINDOWS = 1500
EPOCHS = 6
SPANS = "array<struct<kind:string,start:int,end:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its start only: inside it the outcome is the same
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORDS = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|authorization"
_ASSIGN = rf"(?<![^\W_])(?:{_WORDS})[\"']?[\x20\t]*[=:][\x20\t]*(?:(?<=[\x20\t:])(?:bearer|basic)[\x20\t]+)?"
_TRIGGER = re.compile(rf"[0-9@]+|{_ASSIGN}", re.I)
_CHUNK = re.compile(r"\S*")
_TOKEN = re.compile(r"[^\W_]+|\S")
_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
# a long value, in quotes or not; behind spaces and without quotes it holds a digit (else it may be a word of prose)
_VALUE = r"[A-Za-z0-9](?:[_.+/~-]*+[A-Za-z0-9]){7,}+"
_SECRET = re.compile(
    rf"{_ASSIGN}(?:([\"']){_VALUE}(?:={{0,2}}\1)?|(?:(?<=[=:])|(?<=[cCrR][\x20\t])|(?=[A-Za-z_.+/~-]*[0-9])){_VALUE})", re.I)
_CUE = re.compile(r"(?:password|passwd|pwd|secret|token|key|authorization)\W*$", re.I)
_NUMBERED = re.compile(r"(?:version|section|chapter|page|no|nr|by|license|licence|by-nc)\W*$", re.I)


def luhn(digits: str) -> bool:
    n = [int(c) for c in reversed(digits)]
    return sum(n[0::2] + [d * 2 - 9 * (d > 4) for d in n[1::2]]) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(t: str | None) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by start, then kind."""
    if not t:
        return []
    out = []
    end, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = t.find("@", at + 1)
    if _DIGIT.search(t):
        out += [("ip", *m.span()) for m in _IP.finditer(t) if all(map(_byte, m.group().split(".")))]
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 12:
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in t:
            out += [("phone", *m.span()) for m in _PHONE.finditer(t)
                    if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def windows(t: str) -> list[tuple[int, int]]:
    """Runs of chunks with a digit or ``@`` that single spaces separate."""
    out: list[list[int]] = []
    end = 0
    for m in _TRIGGER.finditer(t):
        if m.start() < end:
            if m.end() > end:  # a cue word at the end of the window goes on behind spaces
                end = out[-1][1] = _CHUNK.match(t, m.end()).end()
            continue
        start = m.start()
        while start > end and not t[start - 1].isspace():
            start -= 1
        new_end = _CHUNK.match(t, m.end()).end()
        if out and start == out[-1][1] + 1 and t[start - 1] == " ":
            out[-1][1] = new_end
        else:
            out.append([start, new_end])
        end = new_end
    return [(a, b) for a, b in out]


_SET = {
    "ip": frozenset("0123456789."), "card": frozenset("0123456789 -"), "phone": frozenset("+0123456789 ().-"),
    "mail": frozenset(_LOCAL | {"@"}), "upper": frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    "hex": frozenset("0123456789abcdef"),
}
N_FEATURES = 28


def span_features(t: str, s: int, e: int, cue: bool, numbered: bool, credential: bool) -> list[float]:
    """Features of the whole span ``t[s:e]``; ``credential``: a cue word and its whole value."""
    x = t[s:e]
    chars = set(x)
    nd = sum(map(x.count, chars & _SET["hex"] & frozenset("0123456789")))
    at = x.count("@")
    digits_only = chars <= frozenset("0123456789")
    in_card, in_phone, in_ip = chars <= _SET["card"], chars <= _SET["phone"], chars <= _SET["ip"]
    parts = x.split(".") if in_ip else []
    quad = len(parts) == 4 and all(p and _byte(p) for p in parts)
    left = s == 0 or not t[s - 1].isalnum()
    right = e == len(t) or not t[e].isalnum()
    left_space = s == 0 or t[s - 1].isspace()
    right_space = e == len(t) or t[e].isspace() or (t[e] in ".,;:!?)" and (e + 1 >= len(t) or t[e + 1].isspace()))
    upper = chars <= _SET["upper"] and 0 < nd < len(x)
    hexed = chars <= _SET["hex"] and 0 < nd < len(x)
    named = "=" in x or ":" in x
    card = in_card and 12 <= nd <= 19
    checked = card and luhn(x.replace(" ", "").replace("-", ""))
    return [1.0, at == 1 and 0 < x.index("@") < len(x) - 1, at == 1 and "." in x[x.index("@"):], at > 1,
            at == 1 and chars <= _SET["mail"], quad, in_ip and not quad and "." in x, x[0] == "+",
            in_phone and 9 <= nd <= 15 and x[0] == "+", in_phone and nd > 15, card, checked, card and not checked,
            digits_only, upper and len(x) >= 16, x.startswith("AKIA"), hexed and len(x) >= 12,
            named and bool(_CUE.search(re.split("[=:]", x)[0])), cue, numbered, left and right, left_space, right_space,
            " " in x, nd < 4 and digits_only, in_phone and nd < 9, x[-1] in _LOCAL, credential]


class Segments:
    """Tokens and scored candidate segments of one window."""

    def __init__(self, t: str, lo: int, hi: int):
        before = t[max(0, lo - 24):lo]
        cue, numbered = bool(_CUE.search(before)), bool(_NUMBERED.search(before))
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(t, lo, hi)]
        hot = [m.span() for m in _TRIGGER.finditer(t, lo, hi)]
        live, k = [], 0
        for a, b in tokens:
            while k < len(hot) and hot[k][1] <= a:
                k += 1
            live.append(k < len(hot) and hot[k][0] < b)
        first = [t[a].isalnum() or t[a] in "+(" for a, _ in tokens]
        last = [t[b - 1].isalnum() for _, b in tokens]
        starts, ends, feats = [], [], []
        ending = {b: j for j, (_, b) in enumerate(tokens)}
        for i, (a, _) in enumerate(tokens):
            if not first[i]:
                continue
            any_live = False
            secret = _SECRET.match(t, a, hi) if live[i] else None
            whole = ending.get(secret.end()) if secret else None
            for j in range(i, min(i + MAX_TOKENS, len(tokens))):
                any_live = any_live or live[j]
                if tokens[j][1] - a > MAX_CHARS:
                    break
                if any_live and last[j] and j != whole:
                    starts.append(i)
                    ends.append(j + 1)
                    feats.append(span_features(t, a, tokens[j][1], cue, numbered, False))
            if whole is not None:  # a credential, with its closing quote, is a candidate at any length
                starts.append(i)
                ends.append(whole + 1)
                feats.append(span_features(t, a, tokens[whole][1], cue, numbered, True))
        self.tokens = tokens
        self.starts, self.ends = np.array(starts, int), np.array(ends, int)
        self.feats = np.array(feats, float).reshape(-1, N_FEATURES)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = np.max(x, axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


class SemiCRF:
    """Weights per (feature, type) and transitions; state 0 is the background."""

    def __init__(self):
        self.w = np.zeros((N_FEATURES, len(KINDS)))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def best(self, g: Segments) -> list[tuple[str, int, int]]:
        """Highest-scoring segmentation: its entity spans in characters."""
        n = len(g.tokens)
        if not len(g.starts):
            return []
        score = g.feats @ self.w
        by_end: dict[int, list[int]] = {}
        for k, e in enumerate(g.ends.tolist()):
            by_end.setdefault(e, []).append(k)
        v = np.full((n + 1, len(KINDS) + 1), -np.inf)
        v[0, 0] = 0.0
        came: list[dict[int, tuple[int, int]]] = [{} for _ in range(n + 1)]
        enter = [None] * (n + 1)  # per boundary: best score and state to enter each state from
        for e in range(1, n + 1):
            step = v[e - 1][:, None] + self.t
            enter[e - 1] = (step.max(axis=0), step.argmax(axis=0))
            v[e, 0], came[e][0] = enter[e - 1][0][0], (e - 1, int(enter[e - 1][1][0]))
            for k in by_end.get(e, ()):
                i = int(g.starts[k])
                total = enter[i][0][1:] + score[k]
                for y in np.flatnonzero(total > v[e, 1:]).tolist():
                    v[e, y + 1] = total[y]
                    came[e][y + 1] = (i, int(enter[i][1][y + 1]))
        e, y, out = n, int(v[n].argmax()), []
        while e > 0:
            i, before = came[e][y]
            if y:
                out.append((KINDS[y - 1], g.tokens[i][0], g.tokens[e - 1][1]))
            e, y = i, before
        return out[::-1]

    def gradient(self, g: Segments, gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the log likelihood of the gold segmentation ``{(start, end): kind}``."""
        n, k = len(g.tokens), len(KINDS) + 1
        score = g.feats @ self.w
        alpha, a_in = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        alpha[0, 0] = 0.0
        for e in range(n + 1):
            if e:
                alpha[e, 0] = a_in[e - 1, 0]
                own = np.flatnonzero(g.ends == e)
                if len(own):
                    alpha[e, 1:] = _lse(a_in[g.starts[own], 1:] + score[own], 0)
            a_in[e] = _lse(alpha[e][:, None] + self.t, 0)
        beta, b_out = np.zeros((n + 1, k)), np.full((n + 1, k), -np.inf)
        for i in range(n - 1, -1, -1):
            b_out[i, 0] = beta[i + 1, 0]
            own = np.flatnonzero(g.starts == i)
            if len(own):
                b_out[i, 1:] = _lse(score[own] + beta[g.ends[own], 1:], 0)
            beta[i] = _lse(self.t + b_out[i][None, :], 1)
        z = beta[0, 0]
        hot = np.zeros_like(score)
        for j, (s, e) in enumerate(zip(g.starts.tolist(), g.ends.tolist())):
            if (s, e) in gold:
                hot[j, gold[s, e]] = 1.0
        gw = g.feats.T @ (hot - np.exp(a_in[g.starts, 1:] + score + beta[g.ends, 1:] - z))
        gt = -np.exp(alpha[:n, :, None] + self.t[None] + b_out[:n, None, :] - z).sum(axis=0)
        at, y = 0, 0
        begins = {s: (e, kind + 1) for (s, e), kind in gold.items()}
        while at < n:
            e, nxt = begins.get(at, (at + 1, 0))
            gt[y, nxt] += 1
            at, y = e, nxt
        return gw, gt

    def fit(self, data: list[tuple[Segments, dict]], epochs: int = EPOCHS, rate: float = 0.5) -> "SemiCRF":
        """AdaGrad over the windows in a fixed order."""
        hw, ht = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        for _ in range(epochs):
            for g, gold in data:
                gw, gt = self.gradient(g, gold)
                gw -= 1e-3 * self.w
                gt -= 1e-3 * self.t
                hw += gw * gw
                ht += gt * gt
                self.w += rate * gw / np.sqrt(hw)
                self.t += rate * gt / np.sqrt(ht)
        return self


def labelled_windows(t: str) -> list[tuple[Segments, dict]]:
    """Windows with the segmentation that the patterns give them."""
    marks = base_spans(t) + [(k, *m.span()) for k, p in (("key", _KEY), ("secret", _SECRET)) for m in p.finditer(t)]
    out = []
    for lo, hi in windows(t):
        g = Segments(t, lo, hi)
        if not len(g.starts) or len(g.tokens) > 4 * MAX_TOKENS:
            continue
        known = {(a, b): k for k, (a, b) in enumerate(zip(g.starts.tolist(), g.ends.tolist()))}
        first = {a: i for i, (a, _) in enumerate(g.tokens)}
        last = {b: i + 1 for i, (_, b) in enumerate(g.tokens)}
        gold, end, fits = {}, -1, True
        for kind, s, e in sorted((x for x in marks if lo <= x[1] < hi), key=lambda x: (x[1], -x[2])):
            if s < end:
                continue
            at = (first.get(s), last.get(e))
            fits = fits and at in known
            gold[at] = KINDS.index(kind)
            end = e
        if fits:
            out.append((g, gold))
    return out


def fit_model(docs: DataFrame, text: str = "text", sample: int = SAMPLE, limit: int = WINDOWS) -> SemiCRF:
    """Fit on the windows of about ``sample`` documents, chosen by a hash of the row."""
    n = docs.count()
    # rows, not texts, are drawn: many copies of one text don't come together
    drawn = F.pmod(F.xxhash64(*docs.columns), F.lit(n)) < sample if n > sample else F.lit(True)
    # credentials are rare: their windows are taken from all documents
    d = (docs.select(F.col(text).alias("t"), drawn.alias("drawn")).filter(F.col("t").isNotNull())
         .filter(F.col("drawn") | F.col("t").rlike(f"(?i){_WORDS}|AKIA")))

    def cut(batches):
        for b in batches:
            rows = []
            for t, drawn in zip(b.column("t").to_pylist(), b.column("drawn").to_pylist()):
                for lo, hi in windows(t):
                    if hi - lo <= 4 * MAX_CHARS:
                        rare = bool(_SECRET.search(t, lo, hi) or _KEY.search(t, lo, hi))
                        if drawn or rare:
                            rows.append((t[max(0, lo - 24):hi + 2], rare))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()),
                                              pa.array([r for _, r in rows], pa.bool_())], names=["w", "rare"])

    texts = stage(d.mapInArrow(cut, "w string, rare boolean").groupBy("w").agg(F.max("rare").alias("rare"))
                  .withColumn("h", F.xxhash64("w")), "personal-windows")
    rare = texts.filter("rare").orderBy("h", "w").limit(limit // 4).collect()
    rest = texts.filter("NOT rare").orderBy("h", "w").limit(limit - len(rare)).collect()
    data = [x for r in sorted(rare + rest, key=lambda r: (r["h"], r["w"])) for x in labelled_windows(r["w"])]
    return SemiCRF().fit(data)


def find(docs: DataFrame, model: SemiCRF, text: str = "text") -> DataFrame:
    """``docs`` with ``__base_spans`` and ``__added_spans`` (kind, start, end in code points)."""
    out = docs.withColumns({"__base_spans": F.lit(None).cast(SPANS), "__added_spans": F.lit(None).cast(SPANS)})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def pack(rows):
        return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in r] for r in rows], span_type)

    def run(batches):
        crf = shared.value
        for b in batches:
            base, added = [], []
            for t in b.column(text):
                t = t.as_py()
                own = base_spans(t)
                base.append(own)
                added.append(added_spans(t, own, crf))
            new = {"__base_spans": pack(base), "__added_spans": pack(added)}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in b.schema.names], names=b.schema.names)

    return out.mapInArrow(run, schema)


def added_spans(t: str | None, own: list, crf: SemiCRF) -> list[tuple[str, int, int]]:
    """Spans of the model that overlap no base span; of a credential that does, the parts around them."""
    if not t:
        return []
    out, k = [], 0
    for lo, hi in windows(t):
        while k < len(own) and own[k][1] < lo:
            k += 1
        near = [x for x in own[max(0, k - 8):] if x[1] < hi and x[2] > lo] if own else []
        for s in crf.best(Segments(t, lo, hi)):
            over = [x for x in near if x[1] < s[2] and x[2] > s[1]]
            if not over:
                out.append(s)
            elif s[0] in KINDS[4:]:
                at = s[1]
                for _, a, b in [*over, ("", s[2], s[2])]:
                    if a > at:
                        out.append((s[0], at, a))
                    at = max(at, b)
    return out


def all_spans():
    """Base and added spans by start, then kind, then end."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    return F.transform(
        F.array_sort(F.transform(F.concat("__base_spans", "__added_spans"), lambda s: F.struct(
            s["start"].alias("start"), order[s["kind"]].alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def span_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def mask(found: DataFrame, text: str = "text") -> DataFrame:
    """Every span replaced by its kind in brackets; overlapping spans become one."""
    schema = found.schema

    def run(batches):
        for b in batches:
            texts = b.column(text).to_pylist()
            base, added = b.column("__base_spans").to_pylist(), b.column("__added_spans").to_pylist()
            for i, (x, y) in enumerate(zip(base, added)):
                if x or y:
                    texts[i] = masked(texts[i], [(s["kind"], s["start"], s["end"]) for s in x + y])
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == text else b.column(c) for c in b.schema.names],
                names=b.schema.names)

    return found.mapInArrow(run, schema).drop("__base_spans", "__added_spans")


def masked(t: str, spans: list[tuple[str, int, int]]) -> str:
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])):
        if s >= end:
            out += [t[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, t[end:]])
