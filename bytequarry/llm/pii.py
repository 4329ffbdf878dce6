"""Personal data: exact base patterns, then a skip-chain conditional random field that adds what the patterns miss.

The base patterns give e-mail addresses, IP addresses, payment cards and telephone numbers. The field's nodes are tokens
(runs of digits, runs of letters, single marks), its labels the begin and inside of each kind, and nothing. A token can be part of
personal data only inside a *region*: numbers with their separators, or an address that is spelled out. All other tokens
are nothing for certain and tokens of base spans have their span's label for certain, so both enter as fixed neighbours and only
the tokens of regions are nodes, which is exact and leaves few. Chain edges join neighbouring tokens. Skip edges join a token with
the previous equal or similar one, wherever it stands, and with the first one in a base span; similar are equal runs of three
digits or letters, and tokens of numbers with the same last seven digits. Loopy message passing, until no message changes any more,
lets a certain mention decide its repeats, however many there are. A run of tokens becomes a span where each has its kind with a
posterior of ``CERTAIN`` or more. A token that recurs n times has fewer than 3n skip edges.

All weights, those of features, of chain edges and of skip edges, are trained together, on the token sequences of documents
that a seeded generator writes with their labels; no corpus row is used, so results are the same at every size.
Documents are independent: one narrow map.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.llm._common import map_rows, tidy

KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(KINDS)}
#: Labels of the field: 0 is nothing, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
CERTAIN = 0.8
#: Types of skip edges: equal tokens, tokens of numbers with equal ends, and either of them with a token of a base span.
SKIPS = 3
#: A message that changes by no more than this isn't sent on.
TOLERANCE = 1e-6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![A-Za-z0-9_.,+])[+(]{0,2}[0-9]++(?:[ ().\-/\[\]]{1,3}[0-9]++)*+(?![A-Za-z_]|[.,][0-9])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:[(\[{<] ?at ?[)\]}>]|@| at ) ?[A-Za-z0-9-]{1,63}(?:(?: ?[(\[{<] ?dot ?[)\]}>] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}", re.I)
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")
_HINT = re.compile(r"[0-9@]|\Wat\W|\Wdot\W", re.I)
_TLD = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info"}
_CUES = (re.compile(r"mail|contact|write|correo|courriel", re.I), re.compile(r"\bip\b|address|host|server|adresse", re.I), re.compile(r"card|visa|credit|carte|tarjeta|karte|payment", re.I), re.compile(r"phone|tel|call|fax|mobile|cell|ruf|telefon|teléfono|appel", re.I))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind; leftmost non-overlapping for each kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if m := _DOMAIN.match(text, at + 1) if start < at else None:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda s: (s[0], _RANK[s[2]]))
    return out


# ------------------------------------------------------------------ tokens, features and edges


class Field:
    """The field of one text: tokens of its regions as (start, end), their features, chain neighbours and skip edges."""

    def __init__(self, text: str, base: list[tuple[int, int, str]]):
        self.tokens: list[tuple[int, int]] = []
        self.features: list[list[str]] = []
        #: (token, whether it goes on from the one before it, label before it if that one is fixed)
        self.start: list[int | None] = []
        self.end: list[bool] = []
        #: (token, token behind it, type)
        self.skips: set[tuple[int, int, int]] = set()
        #: (token, label of a token in a base span)
        self.fixed: set[tuple[int, int]] = set()
        merged: list[list[int]] = []
        for s, e, _ in base:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        events = [(s, e, -1) for s, e in _regions(text, merged)]
        if not events:
            return
        events = sorted(events + [(s, e, _RANK[k]) for s, e, k in base])
        sure: dict[str, int] = {}
        last: dict[str, int] = {}
        for s, e, k in events:
            if k >= 0:
                for n, key in self._keys(text, s, e):
                    sure.setdefault(key, 1 + 2 * k + (n > 0))
        done = (-1, 0)  # end and last label of the last base span
        for s, e, k in events:
            if k >= 0:
                done = (e, 2 * k + 2)
                for _, key in self._keys(text, s, e):
                    last.pop(key, None)  # what comes behind a base span hears from that span
                continue
            first = len(self.tokens)
            self._add(text, s, e, done[1] if not text[done[0] : s].strip() and done[0] >= 0 else 0)
            keys = self._keys(text, s, e)
            self.skips.update((last[key], first + n, int(key[0] == ".")) for n, key in keys if key in last)
            self.fixed.update((first + n, sure[key]) for n, key in keys if key in sure)
            last.update((key, first + n) for n, key in keys)

    @staticmethod
    def _keys(text: str, s: int, e: int) -> list[tuple[int, str]]:
        """(token's number in the mention, key) by which tokens are equal or similar."""
        found = list(_TOKEN.finditer(text, s, e))
        out = [(n, m[0].lower()) for n, m in enumerate(found) if len(m[0]) >= 3]
        digits = _digits(text[s:e])
        if len(digits) >= 7:
            out += [(n, "..." + digits[-7:]) for n, m in enumerate(found) if m[0][0] in "0123456789"]
        return out

    def _add(self, text: str, s: int, e: int, before: int) -> None:
        found = list(_TOKEN.finditer(text, s, e))
        words = [m[0] for m in found]
        common = _region_features(text[s:e], text[max(0, s - 24) : s])
        kinds = ["#", *map(_kind, words), "#"]
        chunks = _chunks(text, found)
        for n, m in enumerate(found):
            self.tokens.append(m.span())
            place = "only" if len(found) == 1 else "first" if not n else "last" if n == len(found) - 1 else "mid"
            own = [f"t:{kinds[n + 1]}", f"p:{kinds[n]}", f"x:{kinds[n + 2]}", f"@{place}", f"c:{chunks[n]}"]
            if len(m[0]) >= 12 and kinds[n + 1][0] == "d":
                own.append(f"luhn:{luhn(m[0])}")
            self.features.append(["bias", *own, *common])
            self.start.append(before if not n else None)
            self.end.append(n == len(found) - 1)


def _kind(token: str) -> str:
    c = token[0]
    if "0" <= c <= "9":
        return f"d{min(len(token), 20)}"
    return (low if (low := token.lower()) in ("at", "dot") else "tld" if low in _TLD else "w") if c.isalpha() and c.isascii() else token


def _chunks(text: str, found: list) -> list[str]:
    """Of each token: the digits in its stretch without spaces."""
    out, at = [], 0
    while at < len(found):
        end = at + 1
        while end < len(found) and found[end].start() == found[end - 1].end():
            end += 1
        n = sum(m.end() - m.start() for m in found[at:end] if m[0][0] in "0123456789")
        out += [str(min(n, 20))] * (end - at)
        at = end
    return out


def _region_features(s: str, before: str) -> list[str]:
    digits = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    out = [f"n:{min(len(digits), 21)}"]
    if re.search(r"[A-Za-z@]", s):
        out = ["spelled", "marked" if re.search(r"[(\[{<] ?(?:at|dot) ?[)\]}>]", s, re.I) else "said" if re.search(r" at .* dot ", s, re.I) else "plain", f"tld:{s.rsplit('.', 1)[-1].rsplit(' ', 1)[-1].lower() in _TLD}"]
    elif len(groups) <= 6:
        out.append("g:" + "-".join(str(len(g)) for g in groups))
    if 12 <= len(digits) <= 19:
        out.append(f"all:{luhn(digits)}")
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        out.append("quad")
    if re.search(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}", s):
        out.append("date")
    return out + [f"cue:{k}" for k, c in enumerate(_CUES) if c.search(before)]


def _regions(text: str, taken: list[list[int]]) -> list[tuple[int, int]]:
    """Where personal data may be beside the base spans (merged, in order); regions overlap neither those nor each other."""
    found = [m.span() for m in _NUMBER.finditer(text) if m.end() - m.start() >= 7 and (len(_digits(m[0])) >= 7 or len(re.findall("[0-9]+", m[0])) == 4)]
    if re.search(r"@|\bat\b", text, re.I):
        found += [m.span() for m in _SPELLED.finditer(text)]
    out, k, last = [], 0, 0
    for s, e in sorted(found):
        s = max(s, last)
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        j = k
        while s < e:  # what base spans leave of it
            stop = min(e, taken[j][0]) if j < len(taken) else e
            if stop - s >= 7 and (m := re.search(r"\S(?:.*\S)?", text[s:stop], re.S)):
                out.append((s + m.start(), s + m.end()))
            s = taken[j][1] if j < len(taken) else e
            j += 1
        last = max(last, e)
    return out


# ------------------------------------------------------------------ training


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random) -> str:
    body = rng.choice("3456") + _number(rng, 14)
    return next(body + c for c in "0123456789" if luhn(body + c))


def _regrouped(rng: random.Random, digits: str) -> str:
    """A number cut anywhere."""
    sep, out, at = rng.choice((" ", " ", ".", "-")), [], 0
    while at < len(digits):
        n = rng.randint(1, 7)
        out.append(digits[at : at + n])
        at += n
    return sep.join(out)


def _entity(rng: random.Random) -> tuple[int, list[str]]:
    """A kind (0 to 3, or 4 for nothing) and forms in which one value of it may be written; the first is the plainest."""
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    kind = rng.choice((0, 0, 1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 4, 4, 4))
    if kind == 0:
        a, d, top = f"{word()}{rng.choice(('', '.', '_'))}{word()}", word(), rng.choice(sorted(_TLD))
        return 0, [f"{a}@{d}.{top}", f"{a}(at){d}(dot){top}", f"{a} [at] {d} [dot] {top}", f"{a}[at]{d}[dot]{top}", f"{a} (at) {d} (dot) {top}", f"{a} at {d} dot {top}", f"{a} (at) {d}.{top}", f"{a} at {d}.{top}", f"{a}{{at}}{d}.{top}"]
    if kind == 1:
        q = [str(rng.randint(0, 255)) for _ in range(4)]
        return 1, [".".join(q), "[.]".join(q), "(.)".join(q), " . ".join(q)]
    if kind == 2:
        c = _card(rng)
        return 2, [c, *(sep.join(c[i : i + 4] for i in range(0, 16, 4)) for sep in (".", "/", " . ", "  "))]
    if kind == 3:
        a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        return 3, [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"1 {a} {b} {c}", f"1{a}{b}{c}", *(_regrouped(rng, rng.choice(("", "1")) + a + b + c) for _ in range(6))]
    if rng.random() < 0.4:
        digits = _number(rng, rng.choice((7, 8, 9, 10, 10, 10, 11, 11)))
        return 4, [digits, *(_regrouped(rng, digits) for _ in range(4))]
    n = rng.randrange(10)
    s = (
        _number(rng, rng.randint(7, 12)), _number(rng, 10), _number(rng, 16), f"20{_number(rng, 2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/20{_number(rng, 2)}",
        f"{word()} at {word()}.{word()}", f"{_number(rng, 4)}.{_number(rng, 4)}", f"{_number(rng, 3)} {_number(rng, 3)} {_number(rng, 4)}", f"{_number(rng, 5)}-{_number(rng, 4)}", rng.choice((" ", "-", ".")).join(_number(rng, rng.randint(1, rng.choice((2, 5)))) for _ in range(rng.randint(3, 16))),
    )[n]
    while luhn(_digits(s)) and 12 <= len(_digits(s)) <= 19:
        s = s[:-1] + str((int(s[-1]) + 1) % 10)
    return 4, [s]


def _document(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text and its mentions (start, end, kind). Values come once or several times, in one form or several, with cues or without."""
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    cues = (("mail: ", "contact me, ", "write to ", "correo "), ("ip ", "the host ", "server "), ("card ", "visa ", "credit card "), ("phone ", "tel. ", "call ", "fax: ", "mobile "), ("no. ", "item ", "order "))
    mentions = []
    for _ in range(rng.randint(1, 4)):
        kind, forms = _entity(rng)
        for _ in range(rng.choice((1, 1, 2, 3, 5))):
            form = forms[0] if rng.random() < 0.25 else rng.choice(forms)
            # a value stands for something else now and then
            mentions.append((form, kind if rng.random() < 0.99 or form == forms[0] else 4, rng.choice(cues[kind]) if rng.random() < 0.45 else ""))
    rng.shuffle(mentions)
    text, out = "", []
    for form, kind, cue in mentions:
        # now and then two stand side by side
        text += " " if text and rng.random() < 0.25 else f" {word()} {word()} {cue}"
        if kind < 4:
            out.append((len(text), len(text) + len(form), kind))
        text += form
    return f"{text} {word()}", out


def _gold(field: Field, mentions: list[tuple[int, int, int]]) -> list[int]:
    out = []
    for s, e in field.tokens:
        k = next(((1 + 2 * kind + (s > a)) for a, b, kind in mentions if a <= s and e <= b), 0)
        out.append(k)
    return out


#: Kind of each label.
_OF = np.array([0, *(1 + k // 2 for k in range(LABELS - 1))])


class Model:
    """features: a row of the weights for each feature; chain: label before x label; skip: gain of equal kinds, by type of edge and kind."""

    def __init__(self, rows: dict[str, int], features: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.rows, self.features, self.chain, self.skip = rows, features, chain, skip
        self.skip_matrices = [np.where(_OF[:, None] == _OF[None, :], gain[_OF][:, None], 0.0) for gain in skip]

    def unary(self, field: Field) -> np.ndarray:
        """Potentials of the tokens, with what fixed neighbours add."""
        out = np.zeros((len(field.tokens), LABELS))
        for i, names in enumerate(field.features):
            out[i] = self.features[[self.rows[f] for f in names if f in self.rows]].sum(0)
            if field.start[i] is not None:
                out[i] += self.chain[field.start[i]]
            if field.end[i]:
                out[i] += self.chain[:, 0]
        for i, k in field.fixed:
            out[i] += self.skip_matrices[SKIPS - 1][k]
        return out

    def edges(self, field: Field) -> list[tuple[int, int, np.ndarray]]:
        chain = [(i - 1, i, self.chain) for i, k in enumerate(field.start) if k is None]
        return chain + [(a, b, self.skip_matrices[t]) for a, b, t in sorted(field.skips)]


def _sums(z: np.ndarray, turns: list[np.ndarray], chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the tokens and expected label pairs of chains. turns: the first tokens of all chains, longest first, then the second ones, ..."""
    e, move = np.exp(z - z.max(1, keepdims=True)), np.exp(chain)
    ahead, back, p = np.empty_like(e), np.empty_like(e), np.empty_like(e)
    for t, at in enumerate(turns):
        x = e[at] if not t else e[at] * (ahead[turns[t - 1][: len(at)]] @ move)
        ahead[at] = x / x.sum(1, keepdims=True)
    pairs = np.zeros_like(chain)
    for t in range(len(turns) - 1, -1, -1):
        at = turns[t]
        back[at] = 1.0
        if t + 1 < len(turns):
            nxt = turns[t + 1]
            x = e[nxt] * back[nxt]
            both = x @ move.T
            q = ahead[at[: len(nxt)]]
            total = (q * both).sum(1, keepdims=True)
            pairs += (q / total).T @ x * move
            back[at[: len(nxt)]] = both / both.sum(1, keepdims=True)
        x = ahead[at] * back[at]
        p[at] = x / x.sum(1, keepdims=True)
    return p, pairs


@lru_cache(maxsize=1)
def train(seed: int = 11, documents: int = 1400, steps: int = 60) -> Model:
    """All weights together, by gradient ascent (Adam) on generated documents.

    What is maximised is the likelihood of each region's labels given its features and the labels of its skip neighbours, summed over the
    regions: a pseudo-likelihood by regions, exact along the chain.
    """
    rng = random.Random(seed)
    rows: dict[str, int] = {}
    x, y, start, end, pairs, fixed = [], [], [], [], [], []
    for _ in range(documents):
        text, mentions = _document(rng)
        field = Field(text, base_spans(text))
        first = len(y)
        x += [[rows.setdefault(f, len(rows)) for f in names] for names in field.features]
        y += _gold(field, mentions)
        start += [-1 if k is None else k for k in field.start]
        end += field.end
        pairs += [(first + a, first + b, t) for a, b, t in field.skips]
        fixed += [(first + i, k) for i, k in field.fixed]
    n, y, start, end = len(y), np.array(y), np.array(start), np.flatnonzero(end)
    on = np.zeros((n, len(rows)), np.float32)
    for i, names in enumerate(x):
        on[i, names] = 1
    near = np.zeros((SKIPS, n, len(KINDS) + 1))  # skip neighbours of each kind
    for a, b, t in pairs:
        near[t, a, _OF[y[b]]] += 1
        near[t, b, _OF[y[a]]] += 1
    for i, k in fixed:
        near[SKIPS - 1, i, _OF[k]] += 1
    begin = np.flatnonzero(start >= 0)
    sizes = np.diff(np.r_[begin, n])
    order = np.argsort(-sizes, kind="stable")
    turns = [begin[order][sizes[order] > t] + t for t in range(sizes.max())]
    one, kinds = np.eye(LABELS), np.eye(len(KINDS) + 1)[_OF]
    inner = np.flatnonzero(start < 0)
    told = one[y[inner - 1]].T @ one[y[inner]]
    at = [np.zeros((len(rows), LABELS)), np.zeros((LABELS, LABELS)), np.zeros((SKIPS, len(KINDS) + 1))]
    m, v = [np.zeros_like(w) for w in at], [np.zeros_like(w) for w in at]
    for step in range(1, steps + 1):
        w, t, s = at
        z = on @ w.astype(np.float32) + sum(near[k] * s[k] for k in range(SKIPS)) @ kinds.T
        z[begin] += t[start[begin]]
        z[end] += t[:, 0]
        p, expected = _sums(z, turns, t)
        miss = one[y] - p
        chain = told - expected + one[start[begin]].T @ miss[begin]
        chain[:, 0] += miss[end].sum(0)
        grads = [on.T @ miss.astype(np.float32), chain, (near * (miss @ kinds)).sum(1)]
        for k, g in enumerate(grads):
            g = g / n - 1e-4 * at[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            at[k] = at[k] + 0.2 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Model(rows, *at)


# ------------------------------------------------------------------ inference


def propagate(unary: np.ndarray, edges: list[tuple[int, int, np.ndarray]], tolerance: float = TOLERANCE) -> np.ndarray:
    """Posterior marginals by loopy sum-product. unary: nodes x labels, as logarithms; edges: (a, b, potentials of a's label x b's label).

    All messages whose sender has heard news are sent at once, until none changes by more than the tolerance. On a tree the
    marginals are exact. Messages that still change after ``n`` + 50 rounds, which only loops do, are damped; the bound on the rounds grows with n.
    """
    n, k = unary.shape
    belief = unary.astype(float).copy()
    if not edges:
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    kinds: dict[int, int] = {}
    matrices: list[np.ndarray] = []
    for _, _, t in edges:
        if id(t) not in kinds:
            kinds[id(t)] = len(matrices)
            matrices += [t, t.T]
    peak = [float(t.max()) for t in matrices]
    moves = [np.exp(t - x) for t, x in zip(matrices, peak, strict=True)]
    src = np.array([x for a, b, _ in edges for x in (a, b)])
    dst = np.array([x for a, b, _ in edges for x in (b, a)])
    kind = np.array([kinds[id(t)] + x for _, _, t in edges for x in (0, 1)])
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange(n + 1))
    sent = np.zeros((len(src), k))
    active = np.arange(len(src))
    for turn in range(4 * n + 400):
        out = belief[src[active]] - sent[active ^ 1]
        p = np.exp(out - out.max(1, keepdims=True))
        new = np.empty_like(p)
        for x, move in enumerate(moves):
            own = kind[active] == x
            if own.any():
                new[own] = np.log(p[own] @ move + 1e-300)
        new -= new.max(1, keepdims=True)
        if turn > n + 50:
            new = 0.5 * (new + sent[active])
        change = new - sent[active]
        far = np.abs(change).max(1) > tolerance
        if not far.any():
            break
        told = active[far]
        sent[told] = new[far]
        np.add.at(belief, dst[told], change[far])
        heard = np.unique(dst[told])
        sizes = first[heard + 1] - first[heard]
        active = order[np.repeat(first[heard] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find(text: str | None, model: Model | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text, each by start, then kind. Without a model, the trained one."""
    if not text or not _HINT.search(text):
        return [], []
    base = base_spans(text)
    field = Field(text, base)
    if not field.tokens:
        return base, base
    model = model or train()
    p = propagate(model.unary(field), model.edges(field))
    by_kind = p[:, 1::2] + p[:, 2::2]
    label, best = p.argmax(1).tolist(), by_kind.argmax(1).tolist()
    runs: list[list[int]] = []
    for i, (s, e) in enumerate(field.tokens):
        if by_kind[i, best[i]] <= 0.5:
            continue
        if runs and runs[-1][4] == i - 1 and field.start[i] is None and runs[-1][2] == best[i] and label[i] % 2 == 0:
            runs[-1][1], runs[-1][4] = e, i
            runs[-1][3] = min(runs[-1][3], by_kind[i, best[i]])
        else:
            runs.append([s, e, best[i], by_kind[i, best[i]], i])
    added = [(s, e, KINDS[k]) for s, e, k, sure, _ in runs if sure >= CERTAIN and e - s >= 7]
    return base, sorted([*base, *added], key=lambda s: (s[0], _RANK[s[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str | None, model: Model | None = None) -> str | None:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    spans = find(text, model)[1]
    k = 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
        k += 1
    return "".join([*out, text[at:]]) if out else text


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    The counts and the checksum are of the base patterns; ``spans`` also holds what the field adds (``n_added`` of ``n_spans``). Offsets are code
    points, ends exclusive; spans with the same start come in the order of the kinds. Whole texts are read, of any length; a null or empty one has
    no spans. Repeated rows give repeated results, an empty table gives none; other columns are ignored, whatever their names.
    """
    kind = df.schema[id_col].dataType.simpleString()
    model = train()

    def run(ids, texts):
        got = [find(t, model) for t in texts]
        out = {id_col: ids}
        for k in KINDS:
            out[f"n_{k}"] = [sum(s[2] == k for s in b) for b, _ in got]
        out["base_sha256"] = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got]
        out["spans"] = [joined(a) for _, a in got]
        out["n_added"] = [len(a) - len(b) for b, a in got]
        out["n_spans"] = [len(a) for _, a in got]
        return out

    return map_rows(df, run, [id_col, text_col], f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long", rows=500)


def redact_rows(df: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``df`` with every personal datum in ``text_col`` replaced; where there is a length column, it follows the new text.

    Overlapping spans are replaced as one, by the kind of the first. Null and empty texts, and their lengths, stay as they are; texts are read
    whole. Rows and columns, of any names, stay as they are otherwise, repeated rows too; an empty table gives an empty one.
    """
    at = df.columns.index(text_col)
    names = df.columns
    model = train()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                piece = batch.slice(k, 500)
                texts = pa.array([redact(t, model) for t in piece.column(at).to_pylist()], piece.column(at).type)
                yield pa.RecordBatch.from_arrays([texts if i == at else piece.column(i) for i in range(len(names))], schema=piece.schema)

    out = df.mapInArrow(lambda batches: tidy(run(batches)), df.schema)
    if length_col in names:
        kind = df.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(kind)))
    return out
