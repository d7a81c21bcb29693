"""Personal data: patterns for four kinds, and spans found by a linear-chain conditional random field.

Patterns (base spans): e-mail addresses, IPv4 addresses, card numbers and phone numbers; for each kind the leftmost
matches that don't overlap, those failing the kind's test dropped. The field adds spans the patterns miss: credentials,
and the four kinds in other writings. It labels every word of a text by features of the word's shape and of its
neighbours (one after, two before), is trained in the driver from a small labelled table (``labelled``), and is decoded
by Viterbi in numpy batches. The best path holds an entity only if it is worth at least as much as O's in its place;
bounds tell which words can't be in such a one, and chains are what lies between those. So the result is that of decoding
whole texts. Added spans never overlap base spans.

Null texts are empty (no spans); places are code points; every text and every word is scanned whole, in linear time;
repeated rows are judged each on its own; null ids are carried; an empty table gives an empty result; other columns are
not read by ``found`` and are carried by ``redacted``, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

KINDS = ("email", "ip", "card", "phone", "secret")

#: Tried at the start of a run of digits only: what fails there fails behind it, so runs of any length cost one pass.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """The leftmost matches by their @: a local part is the run of its characters before one, so no start is tried twice."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def _byte_sized(parts: list[str]) -> bool:
    """Whether all numbers are at most 255, whatever zeros they start with."""
    bare = [p.lstrip("0") for p in parts]
    return all(len(p) < 4 and int(p or "0") <= 255 for p in bare)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by kind and start."""
    found = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if _byte_sized(m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
    return found


# The field.

LABELS = ("O", "B-email", "I-email", "ip", "B-card", "I-card", "B-phone", "I-phone", "secret")
#: I labels only follow their kind.
NEVER = np.array([[-1e4 if b.startswith("I-") and a[2:] != b[2:] else 0.0 for b in LABELS] for a in LABELS])
#: A word's features count for itself, the next word, the one before, and the next but one.
ROLES = (0, 1, -1, 2)
WORD = re.compile(r"[^ \t-\r]+")
#: Words that say what their neighbour is, without case and marks.
CONTEXT = "token password passwd pwd secret key apikey api_key access_key bearer phone tel telephone call mobile fax card visa iban account ip host server address email mail at dot".split()
PREFIXES = ("AKIA", "ASIA", "sk_", "sk-", "pk_", "ghp_", "gho_", "xoxb", "xoxp", "AIza", "eyJ")
EDGES = "\"'`()[]{}<>,;:.!?"
AT = re.compile(r"[\[({]\s*at\s*[\])}]|\bat\b|@", re.IGNORECASE)


def shape(word: str) -> str:
    """Runs of upper case, lower case and digits as A, a and 9 (twice if longer than two); marks stay."""
    out = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_a-z]", "A", re.sub(r"[a-zß-öø-ÿ]", "a", word)))
    return re.sub(r"(.)\1{2,}", r"\1\1+", out)


def features(word: str) -> list[str]:
    bare = word.strip(EDGES)
    name = bare.lower().rstrip("=:").replace("-", "_")
    digits = sum(c.isdigit() for c in bare)
    letters = sum(c.isalpha() for c in bare)
    out = ["bias", f"len{min(6, len(bare) // 4)}", f"digits{min(digits, 8) if digits < 12 else 12 + (digits > 15)}", f"letters{min(letters, 3)}"]
    out += [f"has{c}" for c in "@.-+(=_/:%$,#" if c in bare]
    if word.endswith((":", "=")):
        out.append("leads")
    if name in CONTEXT:
        out.append(f"says {name}")
        if word.endswith((":", "=")):
            out.append(f"asks {name}")
    if "=" in bare and bare.split("=")[0].lower().replace("-", "_") in CONTEXT:
        out.append("names its value")
    if bare.startswith(PREFIXES):
        out.append("credential prefix")
    if word[:1] in "([{" and name == "at":
        out.append("written at")
    if re.search(r"[^\s\W][\[({]at[\])}][^\s\W]", bare, re.IGNORECASE):
        out.append("address with a written at")
    changes = len(re.findall(r"[A-Za-z][0-9]|[0-9][A-Za-z]", bare))
    out.append(f"mixed{min(changes, 6)}")
    if bare.count(".") == 3 and not letters:
        out.append("three dots")
    if re.fullmatch(r"[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,6}", bare.lower()):
        out.append("domain")
    out.append(f"long{len(bare) >= 16}{changes >= 3}")
    out.append(f"shape {shape(bare)}")
    return out


class _Classes(dict):
    """Code point -> one of its class, where ``features`` can't tell them apart; others stay."""

    def __missing__(self, c: int) -> int:
        x = chr(c)
        if re.match(r"[a-zß-öø-ÿ]", x):
            out = "a" if x.isascii() else "é"
        elif re.match(r"[0-9]", x):
            out = "9"
        elif x.isalpha() and re.match(r"[^\W\d_a-z]", x):
            out = "A" if x.isascii() else "É"
        else:
            out = x
        self[c] = ord(out)
        return self[c]


_classes = _Classes()
_CONTEXT = frozenset(CONTEXT)


def signature(word: str) -> str:
    """A word with the same features, one for many: its characters' classes, unless its letters say something."""
    if word.startswith(PREFIXES, len(word) - len(word.lstrip(EDGES))) or not _OPEN.isdisjoint(word) or word.strip(EDGES).lower().rstrip("=:").replace("-", "_") in _CONTEXT:
        return word
    return word.translate(_classes)


_OPEN = frozenset("=([{")


def labelled(n: int = 1000, seed: int = 11) -> list[list[tuple[str, str]]]:
    """The labelled table: sentences of words with labels, from made-up values in plain and misleading surroundings."""
    rnd = random.Random(seed)
    letters, hexa, alnum = "abcdefghijklmnoprstuvw", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    some = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    num = lambda k: some("0123456789", k)

    def filler() -> list[tuple[str, str]]:
        word = some(rnd.choice([letters, letters + "äöüéèçñíó"]), rnd.randint(1, 9) if rnd.random() < 0.8 else rnd.randint(10, 20))
        marks = some("*#&%!|~", 1) * rnd.randint(1, 3)
        return [(rnd.choice([word, word, word.capitalize(), word + ",", word + ".", word + ".", word.upper(), word + marks, word + rnd.choice(",.") + marks, marks]), "O")]

    def plain_number() -> list[tuple[str, str]]:
        return [(rnd.choice([num(rnd.randint(1, 6)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(1)}.{num(2)}", f"{num(2)}%", f"${num(3)},{num(3)}", f"{num(1)}.{num(1)}.{num(1)}", f"({num(4)})", f"no.{num(3)}", f"{some(letters, 3)}-{num(3)}", f"{some(letters, 4).upper()}{num(2)}", f"{num(2)}{some(letters, 2)}", some(letters, rnd.randint(20, 28)), f"https://{some(letters, 6)}.org/{num(4)}", f"{num(4)}/{num(2)}", f"@{some(letters, 5)}"]), "O")]

    def plain_context() -> list[tuple[str, str]]:
        """Words of the context without a value: most say nothing personal."""
        word = lambda: some(letters, rnd.randint(2, 6))
        name = rnd.choice(["token", "password", "secret", "key", "phone", "card", "email", "mail", "call", "account", "server", "address", "host"])
        return [(x, "O") for x in rnd.choice([["the", name, "was", word()], [name, "of", word()], ["a", name, word()], [f"{name}:", word()], [name + rnd.choice([",", "."]), word()], [word(), "at", word()], ["at", f"{word()}.", word()], ["a", "dot", word()], [f"{word()}:", some(letters, rnd.randint(3, 12))], ["see", f"{word()}.org", "at", word()], [word() + "=", num(2)], [f"{word()}-{word()}", word()], [f"{word()}_{word()}", word()], [f"{word()}:", f"{word()}-{word()}"]])]

    def email() -> list[tuple[str, str]]:
        if rnd.random() < 0.35:  # other writings
            who, where = some(letters, rnd.randint(3, 7)), f"{some(letters, rnd.randint(4, 8))}.{rnd.choice(['com', 'org', 'net', 'de'])}"
            at = rnd.choice(["(at)", "[at]", "{at}", "(AT)"])
            if rnd.random() < 0.4:
                return [(f"{who}{at}{where}", "B-email")]
            return [(who, "B-email"), (at, "I-email"), (where, "I-email")]
        return [(f"{some(letters, 5)}{rnd.choice(['', '.' + num(2), '_' + some(letters, 3)])}@{some(letters, 5)}{rnd.choice(['', num(1)])}.{rnd.choice(['example.com', 'org', 'net'])}", "B-email")]

    def ip() -> list[tuple[str, str]]:
        return [(".".join(str(rnd.randint(1, 255)) for _ in range(4)) + rnd.choice(["", ":8080", "/24"]), "ip")]

    def card() -> list[tuple[str, str]]:
        parts = rnd.choice([[num(16)], [num(4) for _ in range(4)], [f"{num(4)}-{num(4)}-{num(4)}-{num(4)}"]])
        return [(p, "B-card" if i == 0 else "I-card") for i, p in enumerate(parts)]

    def phone() -> list[tuple[str, str]]:
        parts = rnd.choice([["+" + num(1), f"({num(3)})", f"{num(3)}-{num(4)}"], [f"+{num(2)}", num(3), num(4), num(3)], [f"({num(3)})", f"{num(3)}-{num(4)}"], [f"+{num(11)}"]])
        return [(p, "B-phone" if i == 0 else "I-phone") for i, p in enumerate(parts)]

    def secret() -> list[tuple[str, str]]:
        value = rnd.choice([some(hexa, 40), some(hexa, 20), some(hexa, 32), some(letters + hexa, 24)])
        name = rnd.choice(["token", "password", "passwd", "pwd", "secret", "api_key", "key"])
        if rnd.random() < 0.4:  # without digits: a value is told by the word before it
            word = lambda: some(letters, rnd.randint(4, 9))
            value = rnd.choice([word() + word(), f"{word()}-{word()}", f"{word()}_{word()}", word().capitalize() + word() + "!", f"{word()}-{word()}-{word()}"])
            name = rnd.choice(["token", "password", "passwd", "pwd", "secret"])
            return rnd.choice([[(name, "O"), ("=", "O"), (value, "secret")], [(f"{name}={value}", "secret")], [(f"{name}:", "O"), (value, "secret")], [(f"{name}:{value}", "secret")]])
        return rnd.choice([[(name, "O"), ("=", "O"), (f'"{value}"', "secret")], [(f"{name}={value}", "secret")], [(f"{name}:", "O"), (value, "secret")], [("AKIA" + some(alnum if rnd.random() < 0.7 else alnum[:26], 16), "secret")], [(rnd.choice(["ghp_", "sk_"]) + some(letters + hexa, 30), "secret")]])

    makers = [email, ip, card, phone, secret, secret, plain_number, plain_number, plain_number, plain_context, plain_context]
    table = []
    for _ in range(n):
        row = []
        for _ in range(rnd.randint(1, 3)):
            for _ in range(rnd.randint(1, 3)):
                row += filler()
            row += rnd.choice(makers)()
        row += filler()
        table.append(row)
    return table


class Field:
    """Weights of word features for each of ROLES, and of label pairs."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.names, self.weights, self.pairs = names, weights, pairs + NEVER
        # By kind: its labels, and what an entity's first and last pair add to a path at most, as against O's in its place.
        into = (self.pairs - self.pairs[:, :1]).max(0)
        away = (self.pairs - self.pairs[:1])[:, [i for i, x in enumerate(LABELS) if not x.startswith("I-")]].max(1)
        self.kinds = []
        for i, x in enumerate(LABELS):
            if x.startswith("B-"):
                self.kinds.append((i, i + 1, into[i] + max(away[i], away[i + 1]), max(self.pairs[i, i + 1], self.pairs[i + 1, i + 1]) - self.pairs[0, 0]))
            elif i and not x.startswith("I-"):
                self.kinds.append((i, None, into[i] + away[i], 0.0))
        self._clear()

    def _clear(self) -> None:
        """Rows of ``table`` by word and by signature; row 0 stands beside a text's ends and adds nothing."""
        self.rows: dict[str, int] = {}
        self.signed: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(ROLES), len(LABELS)))

    def _row(self, word: str) -> int:
        key = signature(word)
        i = self.signed.get(key)
        if i is None:
            i = self.signed[key] = len(self.signed) + 1
            if i >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[i] = self.weights[:, [self.names[f] for f in features(key) if f in self.names]].sum(axis=1)
        self.rows[word] = i
        return i

    def ids(self, words: list[str]) -> list[int]:
        """Rows of ``table``: what each word adds in each role."""
        known = self.rows.get
        return [known(w) or self._row(w) for w in words]

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all labels of all words, texts one after another; and where a text has ended (two rows beside each)."""
        if len(self.rows) > 200_000:
            self._clear()
        ids, edge = [0, 0], [True, True]
        for own in texts:
            ids += [*self.ids(own), 0, 0]
            edge += [False] * len(own) + [True, True]
        x = np.array(ids)
        out = self.table[x, 0]
        out[1:] += self.table[x[:-1], 1]
        out[:-1] += self.table[x[1:], 2]
        out[2:] += self.table[x[:-2], 3]
        return out, np.array(edge)

    def open(self, scores: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Whether a word is in an entity that may be worth at least as much as O's in its place; all others are O in the best path."""
        free = np.zeros(len(edge), dtype=bool)
        for one, more, most, step in self.kinds:
            start = np.where(edge, -1e5, scores[:, one] - scores[:, 0]) + most
            if more is None:
                free |= start >= -1e-4
                continue
            # The best entity with the word: from a start before it or here, on to a place behind it or here.
            on = np.cumsum(np.where(edge, -1e5, scores[:, more] - scores[:, 0] + step))
            best = np.maximum.accumulate(start - on) + np.maximum.accumulate(on[::-1])[::-1]
            free |= best >= -1e-4
        return free & ~edge

    def decode(self, chains: list[np.ndarray], batch: int = 512) -> list[np.ndarray]:
        """Best labels of each chain of scores; chains of like length go together. A chain starts and ends beside an O."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            for part in np.split(own, np.flatnonzero(np.diff([len(chains[i]).bit_length() for i in own])) + 1):
                sizes = np.array([len(chains[i]) for i in part])
                steps, k = int(sizes.max()), len(LABELS)
                emit = np.zeros((len(part), steps, k))
                for j, i in enumerate(part):
                    emit[j, : sizes[j]] = chains[i]
                back = np.zeros((len(part), steps, k), dtype=np.int8)
                score = emit[:, 0] + self.pairs[0]
                ends = score.copy()
                for t in range(1, steps):
                    way = score[:, :, None] + self.pairs[None]
                    back[:, t] = way.argmax(1)
                    score = way.max(1) + emit[:, t]
                    ends[sizes > t] = score[sizes > t]
                label = (ends + self.pairs[:, 0]).argmax(1)
                path = np.zeros((len(part), steps), dtype=int)
                for t in range(steps - 1, -1, -1):
                    on = sizes > t
                    path[on, t] = label[on]
                    label = np.where(on, back[np.arange(len(part)), t, label], label)
                for j, i in enumerate(part):
                    out[i] = path[j, : sizes[j]]
        return out


def train(table: list[list[tuple[str, str]]], rounds: int = 100, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximise the penalised log-likelihood of the table's label chains by gradient steps (Adam) over all rows at once."""
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in features(w)] for w, _ in row] for row in table]
    k, n, steps = len(LABELS), len(table), max(len(r) for r in table)
    gold = np.zeros((n, steps), dtype=int)
    mask = np.zeros((n, steps), dtype=bool)
    at: list[list[int]] = [[], [], [], []]  # role, place, feature
    for i, (row, ids) in enumerate(zip(table, rows, strict=True)):
        for t, (_, label) in enumerate(row):
            gold[i, t], mask[i, t] = LABELS.index(label), True
            for role, away in enumerate(ROLES):
                near = t - away
                if 0 <= near < len(row):
                    for f in ids[near]:
                        at[0].append(role)
                        at[1].append(i * steps + t)
                        at[2].append(f)
    role, place, feature = (np.array(x) for x in at[:3])
    first = NEVER[0]  # a row starts beside an O
    flat = role * len(names) + feature
    # Sums by place and by feature, as sums of runs.
    by_place, by_flat = np.argsort(place, kind="stable"), np.argsort(flat, kind="stable")
    runs = [(own[order][new], new) for own, order in ((place, by_place), (flat, by_flat)) for new in [np.flatnonzero(np.append(True, np.diff(own[order]) != 0))]]
    params = np.zeros((len(ROLES) * len(names) + k) * k)
    m, v = np.zeros_like(params), np.zeros_like(params)
    onehot = np.eye(k)[gold] * mask[..., None]
    cut = len(ROLES) * len(names) * k
    for step in range(1, rounds + 1):
        w, pairs = params[:cut].reshape(-1, k), params[cut:].reshape(k, k) + NEVER
        emit = np.zeros((n * steps, k))
        emit[runs[0][0]] = np.add.reduceat(w[flat[by_place]], runs[0][1], axis=0)
        emit = emit.reshape(n, steps, k)
        emit[:, 0] += NEVER[0]  # a row starts beside an O
        # Forward and backward sums, scaled to 1 at each step.
        psi, way = np.exp(emit - emit.max(2, keepdims=True)), np.exp(pairs)
        front, rear, scale = np.zeros_like(emit), np.ones_like(emit), np.ones((n, steps, 1))
        for t in range(steps):
            new = psi[:, t] * (front[:, t - 1] @ way if t else 1.0)
            scale[:, t] = np.where(mask[:, t, None], new.sum(1, keepdims=True), 1.0)
            front[:, t] = np.where(mask[:, t, None], new / scale[:, t], front[:, t - 1])
        for t in range(steps - 2, -1, -1):
            rear[:, t] = np.where(mask[:, t + 1, None], (psi[:, t + 1] * rear[:, t + 1] / scale[:, t + 1]) @ way.T, 1.0)
        g_emit = (onehot - front * rear * mask[..., None]).reshape(-1, k)
        g = np.zeros_like(w)
        g[runs[1][0]] = np.add.reduceat(g_emit[place[by_flat]], runs[1][1], axis=0)
        g_pairs = np.zeros((k, k))
        for t in range(1, steps):
            on = mask[:, t]
            g_pairs += onehot[on, t - 1].T @ onehot[on, t] - way * (front[on, t - 1].T @ (psi[on, t] * rear[on, t] / scale[on, t]))
        grad = np.concatenate([g.ravel(), g_pairs.ravel()]) / n - decay * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, pairs = params[: len(ROLES) * len(names) * k].reshape(len(ROLES), len(names), k), params[len(ROLES) * len(names) * k :].reshape(k, k)
    return Field(names, w, pairs)


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's words, in code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = np.concatenate([[False], (c != 32) & ((c < 9) | (c > 13)), [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """The field's spans of each text."""
    words = [WORD.findall(t) for t in texts]
    scores, edge = field.scores(words)
    free = field.open(scores, edge)
    first = np.flatnonzero(free & ~np.append(False, free[:-1]))
    after = np.flatnonzero(free & ~np.append(free[1:], False)) + 1
    base = np.cumsum([2, *[len(w) + 2 for w in words]])  # of each text's first word
    owner = np.searchsorted(base, first, side="right") - 1
    out: list[list[Span]] = [[] for _ in texts]
    known: tuple = (-1, None, None)
    for i, s, labels in zip(owner.tolist(), first.tolist(), field.decode([scores[a:b] for a, b in zip(first, after, strict=True)]), strict=True):
        if not labels.any():
            continue
        if known[0] != i:
            known = (i, *_places(texts[i]))
        last = ""
        for at, y in enumerate(labels.tolist(), start=s - int(base[i])):
            label = LABELS[y]
            kind = label.split("-")[-1]
            if label.startswith("I-") and out[i] and last == kind:
                out[i][-1] = (kind, out[i][-1][1], int(known[2][at]))
            elif label != "O":
                out[i].append((kind, int(known[1][at]), int(known[2][at])))
            last = kind
    return [[x for x in (_trimmed(t, *span) for span in spans) if x and _passes(x[0], t[x[1] : x[2]])] for t, spans in zip(texts, out, strict=True)]


def _passes(kind: str, value: str) -> bool:
    """The kind's test, for the field's spans too."""
    digits = "".join(c for c in value if c in "0123456789")
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "ip":
        own = IP.search(value)
        return bool(own) and _byte_sized(own[0].split("."))
    return kind != "email" or bool(AT.search(value))


def _trimmed(text: str, kind: str, start: int, end: int) -> Span | None:
    """Without marks at the edges; of name=value and name:value, the value."""
    if kind == "secret":
        lead = re.match(r"[^=:]+[=:]+(?=[^=:])", text[start:end])
        start += lead.end() if lead else 0
    edges = EDGES if kind != "phone" else EDGES.replace("(", "")
    while start < end and text[start] in edges:
        start += 1
    while start < end and text[end - 1] in EDGES:
        end -= 1
    return (kind, start, end) if start < end else None


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each text, by kind and start."""
    out = []
    for text, more in zip(texts, field_spans(texts, field), strict=True):
        base = base_spans(text)
        if more:
            starts = sorted((s, e) for _, s, e in base)
            more = [x for x in more if not any(s < x[2] and x[1] < e for s, e in starts)] if starts else more
        out.append((base, sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


#: Texts that are scanned at once.
STEP = 256


def found(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id -> counts of base spans, their digest, and all spans as a string."""
    kind = docs.schema[doc_id].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(_trained())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                some = batch.slice(at, STEP)
                both = all_spans([t or "" for t in some.column(1).to_pylist()], field)
                count = [pa.array([sum(k == x[0] for x in base) for base, _ in both], pa.int64()) for k in KINDS[:4]]
                digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both], pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), *count, digest, pa.array([joined(own) for _, own in both], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(doc_id, text).mapInArrow(task, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


@functools.lru_cache(maxsize=1)
def _trained() -> tuple:
    field = train(labelled())
    return field.names, field.weights, field.pairs


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of its text replaced by the kind in angle brackets; ``length`` follows the text. Other columns stay."""
    from pyspark.sql import functions as F

    model = docs.sparkSession.sparkContext.broadcast(_trained())
    schema = docs.schema
    at = docs.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                some = batch.slice(start, STEP)
                texts = some.column(at).to_pylist()
                clean = [None if t is None else masked(t, own) for t, (_, own) in zip(texts, all_spans([t or "" for t in texts], field), strict=True)]
                columns = list(some.columns)
                columns[at] = pa.array(clean, some.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=some.schema)

    out = docs.mapInArrow(task, schema)
    return out.withColumn(length, F.length(text).cast(schema[length].dataType)) if length in docs.columns else out


def masked(text: str, spans: list[Span]) -> str:
    """Overlapping spans become one, of the first one's kind."""
    out, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"<{kind}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
