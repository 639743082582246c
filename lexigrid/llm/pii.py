"""Personal data and secrets by a skip-chain conditional random field.

Nodes are card, account and telephone numbers in groups and the pattern
matches in whitespace tokens with some evidence (a digit, an ``@``), and the
rests of these tokens that have evidence; all other text is outside entities by
construction, so whole texts are read but only evidence is labelled.  A node's
features are its form, check digits among them, and the words around it.
Neighbouring nodes share a transition potential.  Skip edges join a node to the
next occurrence, however distant, of the same string or of the same shape in
the document, with a potential that favours one label for both: a bare number
that is a telephone number where the text says so is one elsewhere too.
Marginals come from loopy sum-product message passing over each document.

All weights (features, transitions, skip potentials) are fitted together by a
composite likelihood of nodes given their neighbours, on documents made here whose labels are known because the
entities were put there (``made``), and on a bounded sample of the table's own
passages, labelled by strict patterns, from which the model learns what the
table's other numbers look like.
"""

from __future__ import annotations

import functools
import random
import re
import string
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from . import common as C

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN")
#: Bounds of what the model is fitted on: made documents, the table's passages, and characters of a passage.
MADE_DOCS, SAMPLE_PASSAGES, PASSAGE = 1500, 2000, 1000
ROUNDS, DAMPING, CHANGE = 30, 0.3, 1e-4
#: Nodes and messages that are worked on at a time.
BLOCK = 1 << 15

_EVIDENCE = re.compile(r"\S*[0-9@]\S*")
_EMAIL = re.compile(r"[A-Za-z0-9À-ÿ._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")
_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
_KEY = re.compile(r"(?<![A-Za-z0-9_-])(?:(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abprs])[-_][A-Za-z0-9_-]{12,}|(?:AKIA|ASIA)[A-Z0-9]{12,}|AIza[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)+)")
_HEX = re.compile(r"[0-9A-Fa-f]{24,}")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_CARD = re.compile(r"(?<!\d)\d{13,19}(?!\d)")
_LOCAL = re.compile(r"(?<!\d)\d{3}[-.]\d{4}(?!\d)")
_FULL = re.compile(r"(?:\+\d{1,3}[-.]?)?\(?\d{3}\)?[-.]\d{3}[-.]\d{4}(?!\d)")
_AREA, _COUNTRY = re.compile(r"\(\d{3}\)"), re.compile(r"\+\d{1,3}(?!\d)")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])(?:\d{6,11})?|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)?\d\d")
_CORES = (_EMAIL, _UUID, _KEY, _IBAN, _SSN, _FULL, _IP, _IP6, _HEX, _LONG, _CARD, _LOCAL, _AREA, _COUNTRY)
_EVIDENT, _REST = re.compile("[0-9@]"), re.compile(r"[\w+(@].*[\w)]|[\w@]")
_GLUE = ("", "-", ".", "/")
#: Digits in groups, also over several whitespace tokens, and numbers that start with ``+``; not a part of a word, key, decimal or address.
_GROUP = r"(?:\(\d{1,5}\)[   -]?)?\d{1,15}"
_RUN = re.compile(rf"(?<![A-Za-z0-9_@%+-])(?<!\d\.)(?:\+\d{{8,15}}|\+?{_GROUP}(?:[   -]\+?{_GROUP})+|\+?\(\d{{1,5}}\)[   -]?\d{{1,15}})(?![A-Za-z0-9_@%]|[-.]\w)")
_PART, _APART = re.compile(r"\+?(?:\(\d+\)|\d+)"), re.compile(r"(?:\+\d{1,3} )?\(\d{3}\) \d{3}[-.]\d{4}(?!\d)")
#: A telephone number over several nodes.
_SPLIT = re.compile(r"(?:\+\d{1,3}\s{0,3})?\(\d{3}\)\s{0,3}\d{3}[-.]\d{4}(?!\d)")
_CARD_GROUPS = ((4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4))
_WORD = re.compile(r"[^\W\d_]+")


def _luhn(digits: str) -> bool:
    back = [int(x) for x in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * x, 10)) for x in back[1::2])) % 10 == 0


def _mod97(x: str) -> bool:
    """Whether an account number's check digits are right."""
    x = x.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _issuer(digits: str) -> bool:
    return digits[0] in "3456" or 2221 <= int(digits[:4]) <= 2720


def _reach(parts: list[str], seps: list[str]) -> tuple[int, str] | None:
    """``(end, label)`` of the card or telephone number in groups ``parts[:end]``; ``seps[k]`` is before ``parts[k]``.

    A card has its issuers' first digits, and the usual groups or a valid check
    digit.  A telephone number is international (``+`` or ``00``, then as many
    groups as the 15 digits of such numbers let it have), American (3-3-4), or
    national with a leading 0 (10 or 11 digits).
    """
    digits = [re.sub(r"\D", "", x) for x in parts]
    total = np.cumsum([len(x) for x in digits]).tolist()
    one = digits[0]
    even = 1  # groups with the same separator between them
    while even < len(digits) and seps[even] == seps[1]:
        even += 1
    new = next((k for k in range(1, len(digits)) if parts[k][0] == "+"), len(digits))
    zeros = 0 if parts[0][0] == "+" else 2 if re.match(r"00[1-9]", one) and new > 1 and digits[1][0] != "0" else None
    if zeros is not None:
        most = zeros + (11 if one[zeros:].startswith("1") else 15)
        ends = [k for k in range(1, new + 1) if total[k - 1] <= most and (total[k - 1] == most or most != zeros + 11) and total[k - 1] >= zeros + 8]
        return (ends[-1], "PHONE") if ends else None
    if one == parts[0] and len(one) >= 4 and _issuer(one):
        for k in range(min(even, 5, new), 1, -1):
            sizes = tuple(map(len, digits[:k]))
            if 13 <= total[k - 1] <= 19 and parts[:k] == digits[:k] and all(4 <= n <= 6 for n in sizes[:-1]) and (sizes in _CARD_GROUPS or _luhn("".join(digits[:k]))):
                return k, "CARD"
    k = 1 if one == parts[0] == "1" else 0
    if new >= k + 3 and [len(x) for x in digits[k : k + 3]] == [3, 3, 4] and digits[k][0] > "1" and digits[k + 1][0] > "1":
        return k + 3, "PHONE"
    if one[0] == "0" and 2 <= len(one) <= 5 and one[1] != "0" and [len(x) for x in digits[:3]] != [2, 2, 4]:
        ends = [k for k in range(2, min(even, new) + 1) if 10 <= total[k - 1] <= 11 and all(len(x) > 1 for x in digits[:k])]
        return (ends[-1], "PHONE") if ends else None
    return None


def grouped(text: str) -> Iterator[tuple[int, int, str]]:
    """``(start, end, label)`` of the account, card and telephone numbers in groups, but for the forms that ``cores`` finds."""
    accounts = (m for m in _IBAN.finditer(text) if " " in m.group() and _mod97(m.group()))
    account = next(accounts, None)
    for run in _RUN.finditer(text):
        while account is not None and account.start() < run.start():
            yield (*account.span(), "IBAN")
            done, account = account.end(), next(accounts, None)
            if done > run.start():
                break
        else:
            yield from _numbers(text, run)
    while account is not None:
        yield (*account.span(), "IBAN")
        account = next(accounts, None)


def _numbers(text: str, run: re.Match) -> Iterator[tuple[int, int, str]]:
    starts, ends = array("q"), array("q")
    for m in _PART.finditer(text, *run.span()):
        starts.append(m.start())
        ends.append(m.end())
    i, n = 0, len(starts)
    while i < n:
        a = starts[i]
        if m := _APART.match(text, a):
            yield a, m.end(), "PHONE"
            i += sum(x < m.end() for x in starts[i : i + 4])
            continue
        k = min(n, i + 12)
        parts = [text[starts[j] : ends[j]] for j in range(i, k)]
        seps = ["", *(text[ends[j - 1] : starts[j]] for j in range(i + 1, k))]
        if got := _reach(parts, seps):
            used, label = got
            b = ends[i + used - 1]
            if not _FULL.fullmatch(text, a, b) and not _SSN.fullmatch(text, a, b):
                yield a, b, label
            i += used
        else:
            i += 1


def _form(core: str) -> str | None:
    """The label of a core that is one number in groups."""
    if not (core[:1] in "+(" or core[:1].isdigit() or (" " in core and core[:1].isalpha())):
        return None
    got = next(grouped(core), None)
    return got[2] if got and got[:2] == (0, len(core)) else None


def cores(raw: str) -> list[tuple[int, int]]:
    """The parts of a token that entities would cover: every e-mail address, number and key in it, and what evidence lies between them."""
    free, out = [(0, len(raw))], []
    for p in _CORES:
        if p is _EMAIL and "@" not in raw:
            continue
        left = []
        for a, b in free:
            for m in p.finditer(raw, a, b):
                out.append(m.span())
                if m.start() > a:
                    left.append((a, m.start()))
                a = m.end()
            if a < b:
                left.append((a, b))
        free = left
    for a, b in free:
        if _EVIDENT.search(raw, a, b):
            m = _REST.search(raw, a, b)
            out.append(m.span() if m else (a, b))
    return sorted(out)


def spans(text: str) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, near)`` of the nodes: numbers in groups, and at least one for each other token with evidence.

    ``near`` tells whether the node before is a neighbour: only white space is
    between them, or within a token at most a ``-``, ``.`` or ``/``.
    """
    at, last = 0, -1  # the end of the part that is done, of the token or number before
    for x, y in _regions(text):
        for m in _EVIDENCE.finditer(text, at, x):
            before = None
            for a, b in cores(m.group()):
                a, b = m.start() + a, m.start() + b
                yield a, b, text[before:a] in _GLUE if before is not None else last >= 0 and not text[last : m.start()].strip()
                before = b
            last = m.end()
        if y is not None:
            yield x, y, last >= 0 and not text[last:x].strip()
            at = last = y


def _regions(text: str):
    for a, b, _ in grouped(text):
        yield a, b
    yield len(text), None


def shape(core: str) -> str:
    if len(core) >= 24 and _HEX.fullmatch(core):
        return f"hex{len(core)}"
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[^\x00-\x7f]+", "u", re.sub(r"\d", "9", core)))


def _tests(c: str) -> tuple[bool, ...]:
    digits = sum(x.isdigit() for x in c)
    plain = c.isascii() and c.isdigit()
    card = 13 <= len(c) <= 19 and plain
    form = _form(c)
    return (
        True,
        "@" in c,
        bool(_EMAIL.fullmatch(c)),
        bool(_IP.fullmatch(c)) and all(int(x) < 256 for x in c.split(".")),
        c.count(".") == 3,
        bool(_HEX.fullmatch(c)) and not plain,
        card and len(c) == 16,
        card and _luhn(c) and _issuer(c),
        card and len(c) != 16,
        bool(_LOCAL.fullmatch(c)),
        bool(_FULL.fullmatch(c)),
        bool(_AREA.fullmatch(c)),
        bool(_COUNTRY.fullmatch(c)),
        plain,
        digits <= 4 and not c.startswith(("+", "(")),
        5 <= digits <= 12,
        digits >= 13,
        "." in c,
        any(x.isalpha() for x in c),
        len(c) >= 24,
        form == "CARD",
        form == "PHONE",
        bool(_IP6.fullmatch(c)),
        bool(_UUID.fullmatch(c)),
        bool(_KEY.fullmatch(c)),
        bool(_LONG.fullmatch(c)),
        bool(_SSN.fullmatch(c)),
        bool(_IBAN.fullmatch(c)) and _mod97(c),
        bool(_DATE.fullmatch(c)),
        plain and len(c) == 10 and c[0] != "0",
        plain and len(c) in (10, 11) and c[0] == "0",
        plain and len(c) in (7, 8, 9),
        plain and len(c) in (10, 13) and c[:2] in ("15", "16", "17"),
    )


N_FORMS = len(_tests("1")) + 1  # the last one: part of a telephone number over several nodes
#: Characters before and behind a node in which its words are looked for.
BEFORE, BEHIND = 40, 24


def around(text: str, a: int, b: int) -> list[str]:
    """The words near a node: up to three before it, and one behind."""
    before = [f"<{w}" for w in _WORD.findall(text[max(0, a - BEFORE) : a].lower())[-3:]]
    m = _WORD.search(text, b, b + BEHIND)
    return before + ([f">{m.group().lower()}"] if m else [])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # forms and words x labels
    words: dict[str, int]  # feature of a word around a node
    transition: np.ndarray  # labels x labels, log potentials of neighbours
    skip: np.ndarray  # 2 x labels, log potentials of equal labels: same string, same shape


@dataclass
class Nodes:
    """The nodes of one text, as arrays: a node takes about a hundred bytes."""

    start: np.ndarray
    end: np.ndarray
    near: np.ndarray
    features: np.ndarray
    offsets: np.ndarray  # of the nodes in features
    core: np.ndarray
    shape: np.ndarray

    def __len__(self):
        return len(self.start)


def nodes(text: str, words: dict[str, int]) -> Nodes:
    start, end, near, feats, offsets, core, kind = array("q"), array("q"), array("b"), array("i"), array("q", [0]), array("q"), array("q")
    forms = functools.lru_cache(1 << 12)(lambda c: [i for i, x in enumerate(_tests(c)) if x])
    until = 0
    for a, b, n in spans(text):
        c = text[a:b]
        if a >= until and c[0] in "+(" and (m := _SPLIT.match(text, a)):
            until = m.end()
        if a < until:
            feats.append(N_FORMS - 1)
        start.append(a), end.append(b), near.append(n)
        feats.extend(forms(c))
        feats.extend([words[w] for w in around(text, a, b) if w in words])
        offsets.append(len(feats))
        core.append(hash(c)), kind.append(hash(shape(c)))
    return Nodes(*(np.array(x) for x in (start, end)), np.array(near, bool), np.array(feats, np.int64), np.array(offsets), np.array(core), np.array(kind))


def skips(x: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, kind)``: each node and the last one before it of the same string (kind 0), else of the same shape (kind 1), unless they are neighbours."""
    n = len(x)

    def before(keys):
        order = np.argsort(keys, kind="stable")
        out = np.full(n, -1)
        same = keys[order][1:] == keys[order][:-1]
        out[order[1:][same]] = order[:-1][same]
        return out

    one, two = before(x.core), before(x.shape)
    i = np.where(one >= 0, one, two)
    j = np.flatnonzero(i >= 0)
    j = j[~((i[j] == j - 1) & x.near[j])]
    return i[j], j, (one[j] < 0).astype(np.int8)


def _unary(x: Nodes, weights: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), weights.shape[1]), np.float32)
    for a in range(0, len(x), BLOCK):
        o = x.offsets[a : a + BLOCK + 1]
        out[a : a + BLOCK] = np.add.reduceat(weights[x.features[o[0] : o[-1]]], (o[:-1] - o[0]), axis=0)
    return out


def marginals(x: Nodes, model: Model) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product; all messages of a round are computed from those of the round before, a block of edges at a time."""
    belief = _unary(x, model.weights)
    chain = np.flatnonzero(x.near[1:])
    i, j, kind = skips(x)
    e = np.r_[np.c_[chain, chain + 1], np.c_[i, j]].astype(np.int32)
    kinds = np.r_[np.full(len(chain), 2, np.int8), kind]
    table, ties = np.exp(model.transition).astype(np.float32), np.expm1(model.skip).astype(np.float32)
    m = len(e)
    message = np.zeros((2 * m, len(LABELS)), np.float32)  # the first m from i to j, the others back
    fresh = np.empty_like(message)
    for _ in range(ROUNDS if m else 0):
        change, new_belief = 0.0, _unary(x, model.weights)
        for a in range(0, 2 * m, BLOCK):
            at = np.arange(a, min(2 * m, a + BLOCK))
            edge, back = at % m, at >= m
            src, dst = e[edge, back.astype(int)], e[edge, 1 - back.astype(int)]
            p = belief[src] - message[(at + m) % (2 * m)]
            p = np.exp(p - p.max(axis=1, keepdims=True))
            k = kinds[edge]
            out = p.sum(axis=1, keepdims=True) + ties[np.minimum(k, 1)] * p
            c = k == 2
            out[c & ~back], out[c & back] = p[c & ~back] @ table, p[c & back] @ table.T
            out = np.log(out)
            out -= out.max(axis=1, keepdims=True)
            out = DAMPING * message[at] + (1 - DAMPING) * out
            change = max(change, float(np.abs(out - message[at]).max()))
            np.add.at(new_belief, dst, out)
            fresh[at] = out
        message, fresh, belief = fresh, message, new_belief
        if change < CHANGE:
            break
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def strict(x: Nodes) -> np.ndarray:
    """Labels by strict patterns."""
    out = np.zeros(len(x), np.int64)
    has = np.zeros((len(x), N_FORMS), bool)
    row = np.repeat(np.arange(len(x)), np.diff(x.offsets))
    form = x.features < N_FORMS
    has[row[form], x.features[form]] = True
    for k, name in reversed(_STRICT):
        out[has[:, k]] = LABELS.index(name)
    return out


_STRICT = ((2, "EMAIL"), (3, "IP"), (22, "IP"), (26, "SSN"), (27, "IBAN"), (24, "SECRET"), (25, "SECRET"), (5, "SECRET"), (6, "CARD"), (7, "CARD"), (10, "PHONE"), (20, "CARD"), (21, "PHONE"), (N_FORMS - 1, "PHONE"))

#: Words that tell what a number is, in the languages of the table's kind.
CUES = {
    "EMAIL": "mail email write contact courriel schreiben correo",
    "PHONE": "call phone tel mobile fax dial reach number téléphone appelez portable numéro rufen telefon handy nummer llame teléfono móvil número",
    "IP": "host server from address login adresse serveur dirección servidor",
    "CARD": "card visa credit paid payment carte karte kreditkarte bezahlt tarjeta crédito pago",
    "SECRET": "token key secret password apikey bearer clé jeton schlüssel passwort clave contraseña",
    "SSN": "ssn social security taxpayer",
    "IBAN": "iban account bank konto compte cuenta",
    "O": "order invoice item ref ticket tracking isbn version build page id sku part article step serial lot row since year commande facture bestellung rechnung seite pedido factura página timestamp seq",
}
_AFTER = {"PHONE": "please today anytime", "CARD": "expires charged", "O": "items pages shipped delivered rows units"}


def _digits(r: random.Random, n: int, first: str = "123456789") -> str:
    return r.choice(first) + "".join(r.choices(string.digits, k=n - 1))


def _card(r: random.Random, n: int) -> str:
    head = {15: "37", 16: r.choice(["4", "51", "55", "2221", "6011"])}.get(n, r.choice("456"))
    body = head + "".join(r.choices(string.digits, k=n - 1 - len(head)))
    return next(body + d for d in string.digits if _luhn(body + d))


def _iban(r: random.Random) -> str:
    land, body = r.choice(["DE", "FR", "ES", "GB"]), _digits(r, r.choice([18, 20, 23]), string.digits)
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{land}00")) % 97
    x = f"{land}{check:02d}{body}"
    return x if r.random() < 0.5 else " ".join(x[i : i + 4] for i in range(0, len(x), 4))


def _word(r: random.Random) -> str:
    return "".join(r.choices(string.ascii_lowercase + "éñü", k=r.randint(2, 9)))


def _value(label: str, r: random.Random) -> tuple[str, bool]:
    """An entity, or another number for ``O``, and whether only the text around tells what it is."""
    d = lambda n, first="123456789": _digits(r, n, first)
    if label == "EMAIL":
        name = r.choice([f"{_word(r)}.{d(r.randint(1, 3))}", _word(r), f"{_word(r)}_{_word(r)}", f"{_word(r)}.{_word(r)}"])
        x = f"{name}@{_word(r)}{r.choice(['', d(1)])}.{r.choice(['example.com', 'example.org', 'com', 'co.uk', 'net'])}".encode("ascii", "ignore").decode()
        return (x if _EMAIL.fullmatch(x) else "a@b.example.org"), False
    if label == "IP":
        four, six = ".".join(str(r.randrange(256)) for _ in range(4)), ":".join(f"{r.randrange(65536):x}" for _ in range(8))
        return r.choice([four, four, six, f"2001:db8::{r.randrange(65536):x}"]), False
    if label == "PHONE":
        a, b, c = d(3, "23456789"), d(3, "23456789"), d(4, string.digits)
        made_ = [f"({a}) {b}-{c}", f"+{d(r.randint(1, 2))} ({a}) {b}-{c}", f"+{d(2)} (0{d(2)}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+44 20 {d(4)} {d(4)}", f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(4)} {d(4)}", f"+1{a}{b}{c}"]
        return (r.choice(made_), False) if r.random() < 0.5 else (r.choice([a + b + c, a + b + c, "0" + d(r.choice([9, 10])), b + c]), True)
    if label == "CARD":
        x = r.choice([d(16), _card(r, 16), _card(r, 15), _card(r, 19)])
        if len(x) == 16 and _luhn(x) and r.random() < 0.4:
            return r.choice(" -").join(x[i : i + 4] for i in range(0, 16, 4)), False
        return x, False
    if label == "SECRET":
        free = "".join(r.choices(string.ascii_letters + string.digits, k=r.choice([24, 32, 40])))
        return r.choice(["".join(r.choices("0123456789abcdef", k=r.choice([32, 40, 64]))), f"sk-{free}", f"ghp_{free}", "AKIA" + "".join(r.choices(string.ascii_uppercase + "234567", k=16)), f"{free}aZ7", "".join(r.choices("0123456789ABCDEF", k=40))]), False
    if label == "SSN":
        return f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", False
    if label == "IBAN":
        return _iban(r), False
    bare = [d(10), d(10), d(r.choice([5, 6, 7, 8, 9])), "0" + d(r.choice([9, 10])), d(r.choice([11, 12]))]
    if r.random() < 0.45:
        return r.choice(bare), True
    longer = next(x for x in iter(lambda: d(r.choice([13, 14, 15, 17, 18, 19])), None) if not (_luhn(x) and _issuer(x)))
    hexes = "".join(r.choices("0123456789abcdef", k=32))
    uuid = f"{hexes[:8]}-{hexes[8:12]}-{hexes[12:16]}-{hexes[16:20]}-{hexes[20:]}"
    stamp = f"20{d(2, '012')}0{d(1)}1{d(1)}{d(6, '012')}{r.choice(['', d(3)])}"
    dates = [f"{r.randint(1950, 2030)}", f"20{d(2, '012')}-0{d(1)}-1{d(1)}", f"1{d(1)}.0{d(1)}.20{d(2, '012')}", f"1{d(1)}:{r.randint(10, 59)}"]
    small = [f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.", f"{d(1)}.", d(1), d(2), d(3), f"{d(1)},{d(3)}", f"{d(2)}%", f"{d(1)}.{d(1)}.{d(2)}", f"no{d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)} {d(4)}", f"@{_word(r)}", f"{d(1)}rd", f"a{d(3)}-{d(4)}"]
    return r.choice([longer, f"1{r.choice('567')}{d(11)}", stamp, uuid, *dates, *small, *small]), False


def made(seed: int, n: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """``(text, [(start, end, label)])`` of documents made by chance: what only the text around tells is told where it is first, not where it comes again."""
    r = random.Random(seed)
    for _ in range(n):
        parts: list[tuple[str, str | None]] = []
        again: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 6)):
            parts += [(_word(r), None) for _ in range(r.randint(0, 6))]
            if again and r.random() < 0.5:
                parts.append(r.choice(again))
                continue
            label = r.choice([*LABELS, "PHONE", "O", "O", "O", "O"])
            x, unsure = _value(label, r)
            if r.random() < (0.9 if unsure and label != "O" else 0.45):
                parts.append((r.choice(CUES[label].split()) + r.choice(["", "", ":", " =", " " + _word(r), " no"]), None))
            elif unsure and label != "O":
                label = "O"  # nothing tells
            parts.append((x, label))
            if label in _AFTER and r.random() < 0.2:
                parts.append((r.choice(_AFTER[label].split()), None))
            if unsure or r.random() < 0.3:
                again.append((x, label))
        parts += [(_word(r), None) for _ in range(r.randint(0, 4))]
        text, found = "", []
        for x, label in parts:
            quote = r.choice(['"', "(", ""]) if label and r.random() < 0.15 else ""
            text += quote
            if label and label != "O":
                found.append((len(text), len(text) + len(x), label))
            text += x + {'"': '"', "(": ")"}.get(quote, "") + (r.choice([",", ".", ";", "!!", "%%%"]) if r.random() < 0.2 else "") + r.choice([" ", " ", " ", " ", "\n"])
        yield text, found


def _labels(x: Nodes, found: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for a, b, name in found:
        out[(x.start < b) & (x.end > a)] = LABELS.index(name)
    return out


def fit(passages: list[str] = (), seed: int = 1, made_docs: int = MADE_DOCS, steps: int = 200, rate: float = 0.3, decay: float = 3e-5) -> Model:
    """A model fitted on made documents and on passages labelled by ``strict``, by composite likelihood: each label given its features and its neighbours' labels, and given its features alone."""
    texts = [*made(seed, made_docs), *((p, None) for p in passages)]
    count = Counter(w for t, _ in texts for a, b, _ in spans(t) for w in set(around(t, a, b)))
    words = {w: N_FORMS + i for i, w in enumerate(sorted(w for w, n in count.items() if n >= 8))}
    k, width = len(LABELS), N_FORMS + len(words)
    xs, ys, prev, after, ties = [], [], [], [], []
    for text, found in texts:
        x = nodes(text, words)
        if not len(x):
            continue
        y = strict(x) if found is None else _labels(x, found)
        one = np.eye(k, dtype=np.float32)[y]
        dense = np.zeros((len(x), width), np.float32)
        dense[np.repeat(np.arange(len(x)), np.diff(x.offsets)), x.features] = 1
        p, q, tie = np.zeros_like(one), np.zeros_like(one), np.zeros((2, len(x), k), np.float32)
        chain = np.flatnonzero(x.near[1:])
        p[chain + 1], q[chain] = one[chain], one[chain + 1]
        for i, j, kind in zip(*skips(x)):
            tie[kind, i] += one[j]
            tie[kind, j] += one[i]
        for held, new in ((xs, dense), (ys, y), (prev, p), (after, q), (ties, tie)):
            held.append(new)
    x, y, p, q, tie = np.concatenate(xs), np.concatenate(ys), np.concatenate(prev), np.concatenate(after), np.concatenate(ties, axis=1)
    # Each node twice, with its neighbours' labels and without: weights of forms and words mustn't lean on labels that are unsure when it matters.
    x, y = np.concatenate([x, x]), np.concatenate([y, y])
    p, q = (np.concatenate([v, np.zeros_like(v)]) for v in (p, q))
    tie = np.concatenate([tie, np.zeros_like(tie)], axis=1)
    goal = np.eye(k, dtype=np.float32)[y]
    theta = [np.zeros((width, k), np.float32), np.zeros((k, k), np.float32), np.zeros((2, k), np.float32)]
    speed, size = [np.zeros_like(t) for t in theta], [np.full_like(t, 1e-8) for t in theta]
    for step in range(1, steps + 1):
        w, t, s = theta
        score = x @ w + p @ t + q @ t.T + tie[0] * s[0] + tie[1] * s[1]
        e = np.exp(score - score.max(axis=1, keepdims=True))
        miss = (goal - e / e.sum(axis=1, keepdims=True)) / len(y)
        grads = [x.T @ miss - decay * w, p.T @ miss + miss.T @ q - decay * t, (tie * miss).sum(axis=1) - decay * s]
        for i, g in enumerate(grads):
            speed[i] = 0.9 * speed[i] + 0.1 * g
            size[i] = 0.99 * size[i] + 0.01 * g * g
            theta[i] = theta[i] + rate * (speed[i] / (1 - 0.9**step)) / (np.sqrt(size[i] / (1 - 0.99**step)) + 1e-6) * min(1.0, 2 * (1 - step / (steps + 1)))
        # What is said of an entity once counts elsewhere at least as much as what is said of another number.
        theta[2] = np.clip(np.maximum(theta[2], theta[2][:, :1]), 0, 4)
    return Model(theta[0], words, np.clip(theta[1], -4, 4), theta[2])


def entities(text: str, model: Model) -> list[tuple[int, int, str]]:
    """``(start, end, label)`` in characters; neighbouring parts of a phone number make one entity."""
    x = nodes(text, model.words)
    if not len(x):
        return []
    labels = marginals(x, model).argmax(axis=1)
    out: list[tuple[int, int, str]] = []
    last, alone = -2, False
    for i in np.flatnonzero(labels):
        name, a, b = LABELS[labels[i]], int(x.start[i]), int(x.end[i])
        core = text[a:b] if name == "PHONE" else ""
        whole = bool(_FULL.fullmatch(core) or _form(core) or sum(c.isdigit() for c in core) > 8)
        if name == "PHONE" and last == i - 1 and x.near[i] and out[-1][2] == name and not whole and not alone:
            out[-1] = (out[-1][0], b, name)
        else:
            out.append((a, b, name))
        last, alone = i, whole
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, name in found:
        parts += [text[at:a], f"<{name}>"]
        at = b
    return "".join([*parts, text[at:]])


def passages(text: str) -> Iterator[str]:
    """A text's parts of about ``PASSAGE`` characters, cut at white space, that have evidence; characters without a space near are cut anywhere."""
    at = 0
    while at < len(text):
        m = re.compile(r"\s").search(text, min(len(text), at + PASSAGE), at + 2 * PASSAGE)
        end = m.end() if m else min(len(text), at + 2 * PASSAGE)
        if _EVIDENT.search(text, at, end):
            yield text[at:end]
        at = end


def fit_on(docs: DataFrame, text_col: str = "text") -> Model:
    """Fit on the ``SAMPLE_PASSAGES`` passages with evidence of the lowest hash among those of all texts, whole texts included; with none, on made documents alone.

    Repeated passages count once.  A task sends at most the sample's size.
    """
    slim = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def lowest(batches):
        import heapq

        import xxhash

        held: list[int] = []  # the negated hashes as a heap
        chosen: dict[int, str] = {}
        for b in A.slices(batches, "text"):
            col = A.column(b, "text")
            for i in _with_evidence(*A.flat(col)).tolist():
                for p in passages(col[i].as_py()):
                    h = xxhash.xxh3_64_intdigest(p) >> 1
                    if h in chosen or (len(held) >= SAMPLE_PASSAGES and h >= -held[0]):
                        continue
                    chosen[h] = p
                    heapq.heappush(held, -h)
                    if len(held) > SAMPLE_PASSAGES:
                        chosen.pop(-heapq.heappop(held))
        for k in range(0, len(held), 500):
            part = sorted(chosen)[k : k + 500]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([chosen[h] for h in part], pa.string())], ["h", "p"])

    with C.scratch(docs.sparkSession):
        told = C.materialize(slim.mapInArrow(lowest, "h long, p string"), "passages")
        # Hashes alone are ordered; then only the sample's passages go to the driver.
        last = told.select("h").distinct().orderBy("h").limit(SAMPLE_PASSAGES).agg(F.max("h")).first()[0]
        rows = told.where(F.col("h") <= last).dropDuplicates(["h"]).collect() if last is not None else []
    return fit([r.p for r in sorted(rows)])


def _with_evidence(data: np.ndarray, o: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
    return np.unique(np.searchsorted(o, at, "right") - 1)


def mask(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, each entity in its text replaced by ``<LABEL>``.

    Null and empty texts stay as they are; repeated rows are masked alike.
    Tokens are whole: an entity never ends inside one because of a limit.  A
    document's columns other than the text aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in A.slices(batches, text_col):
            col = A.column(b, text_col)
            rows = _with_evidence(*A.flat(col))
            if len(rows):
                new, where = [], np.zeros(b.num_rows, bool)
                for i in rows.tolist():
                    text = col[i].as_py()
                    if found := entities(text, shared.value):
                        new.append(redact(text, found))
                        where[i] = True
                if new:
                    col = pc.replace_with_mask(col, pa.array(where), pa.array(new, col.type))
                    b = b.set_column(b.schema.get_field_index(text_col), b.schema.field(text_col), col)
            yield b

    return docs.mapInArrow(run, docs.schema)


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, entities)`` of each input row: the masked text, and label and place (characters of the original) of each entity, never its value.

    A null text stays null and has no entities.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in A.slices(batches, "text"):
            col = A.column(b, "text")
            texts, found = col, [[] for _ in range(b.num_rows)]
            new, where = [], np.zeros(b.num_rows, bool)
            for i in _with_evidence(*A.flat(col)).tolist():
                text = col[i].as_py()
                if e := entities(text, shared.value):
                    found[i] = [{"label": n, "start": s, "end": t} for s, t, n in e]
                    new.append(redact(text, e))
                    where[i] = True
            if new:
                texts = pc.replace_with_mask(col, pa.array(where), pa.array(new, col.type))
            yield pa.RecordBatch.from_arrays([A.column(b, "id"), texts, pa.array(found, kind)], ["id", "text", "entities"])

    out = slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, text string, entities array<struct<label:string,start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)
