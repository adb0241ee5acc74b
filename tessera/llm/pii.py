"""Personal data: fixed patterns, and a linear-chain conditional random field for secrets.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The random field labels
white-space tokens by features of their word shape and of their neighbours'; it is trained here, from a small
labelled table that training_table() makes, and decoded by Viterbi over padded numpy batches. Only tokens with a
digit, an equals sign, an at sign or a long run of capitals, and those after a cue word or an equals sign, may carry
a label other than O, by a constraint of the model, so stretches without any decode to O and are left out. Its
classes for what the patterns cover only compete with the secret class; what it adds are secrets (keys, tokens,
passwords) that no pattern's span touches.

Not found: letters only without a cue word before them, unless capitals; passwords of several words beyond the first;
addresses and numbers that the patterns refuse (an address part over 255, a card number with a wrong check digit).

Defined cases: a null text is the empty one, without spans; equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as w
from tessera.llm.common import docs_of, map_arrow, slices, texts

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
ORDER = {kind: i for i, kind in enumerate((*KINDS, "secret"))}
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
SLICE_BYTES = 2 << 20
STEP, CELLS = 4096, 1 << 14
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """What the pattern matches, in linear time: an at sign's address begins with the run of local characters before it."""
    past, at = 0, text.find("@")
    while at >= 0:
        before = text[past:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        past = at + 1
        if local and (m := _DOMAIN.match(text, at + 1)):
            yield at - local, m.end(), "email"
            past = m.end()
        at = text.find("@", past)


def _ips(text: str) -> Iterator[Span]:
    """What the pattern matches, in linear time: each four numbers of a maximal chain of numbers and dots."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, end, "ip"
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then kind."""
    out: list[Span] = []
    if "@" in text:
        out += _emails(text)
    if _DIGIT.search(text):
        out += _ips(text)
        for m in PATTERNS["card"].finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PATTERNS["phone"].finditer(text):
                if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]], s[1]))


# the random field

LABELS = ("O", "secret", "email", "ip", "card", "phone", "phone_next")
FEATURES = 1 << 13
_CUES = {"password", "passwd", "pwd", "token", "secret", "key", "api_key", "apikey", "access", "auth", "bearer", "credential", "=", ":", "version", "license", "call", "phone", "mail", "card"}
_NAMES = {"password", "passwd", "pwd", "token", "secret", "key", "api_key", "apikey", "access", "auth", "bearer", "credential"}
_NAMED = re.compile(rb"(?<![a-z0-9])(?:" + "|".join(sorted(_NAMES)).encode() + rb")(?![a-z0-9])")
_LINKS = {"=", ":", "is"}
_QUOTES = "\"'`()[]{}<>,;.!?"
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_RUN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_HEX = re.compile("[0-9a-f]+")


def shape(token: str) -> str:
    """Runs of letters and digits by kind and size class, and other characters as they are."""
    out = []
    for run in _RUN.findall(token):
        if not run[0].isalnum() or not run.isascii():
            out.append(run if run.isascii() else "u")
            continue
        if run.isdigit():
            kind = "9"
        elif run.isalpha():
            kind = "A" if run.isupper() else "a" if run.islower() else "m"
        elif len(run) >= 8 and _HEX.fullmatch(run):
            kind = "h"
        else:
            kind = "K" if run.isupper() else "k" if run.islower() else "x"
        out.append(kind + ("" if len(run) < 4 else "4" if len(run) < 12 else "7" if len(run) < 20 else "8"))
    return re.sub(r"(u)\1+", r"\1", "".join(out))


def _name(token: str) -> str:
    """The name of a secret that a token is or, before a colon or an equals sign, begins with; else empty."""
    head = re.split("[:=]", token, maxsplit=1)[0].translate(_LOWER).strip(_QUOTES)
    return next((x for x in (head, re.split("[_.]", head)[-1]) if x in _NAMES), "")


def _own(token: str) -> list[str]:
    s = shape(token)
    word = token.lower().strip(_QUOTES)
    core = token[slice(*_value(token))]
    out = ["s" + s, "l%d" % min(len(core) // 4, 8), "d%d" % min(sum(c.isdigit() for c in core) // 3, 6), "y" + "".join(sorted({c for c in token if not c.isalnum() and c.isascii()}))]
    if len(core) >= 12 and core.isascii() and core.isalnum() and (core.isupper() or _HEX.fullmatch(core)) and not core.isdigit():
        out += ["long", "p" + core[:4]] if core.isupper() else ["long"]
    for cue in (word, word.split("=", 1)[0].strip(":")):
        if cue in _CUES:
            out.append("w" + cue)
    if (name := _name(token)) and "w" + name not in out:
        out.append("w" + name)
    if name and (":" in token or "=" in token):
        out.append("wnamed" if not core or core.lower() == name else "named")
    return out


def _feature_ids(tokens: list[str]) -> list[list[int]]:
    own = [_own(t) for t in tokens]
    out = []
    for i, mine in enumerate(own):
        names = [*mine, "bias"]
        for step in (-2, -1, 1):
            if 0 <= i + step < len(tokens):
                names += [f"{step}{x}" for x in own[i + step] if x[0] in "sw"]
        out.append([zlib.crc32(x.encode()) % FEATURES for x in names])
    return out


def open_to_labels(token: str, one: str = "", two: str = "") -> bool:
    """The constraint: any other token is O. The tokens one and two before it count too."""
    if any(c in "0123456789=@" for c in token):
        return True
    core = token[slice(*_value(token))]
    if _capitals(token, core):
        return True
    if not core or token.translate(_LOWER) in _LINKS:
        return False
    return bool(_name(one) or one.endswith("=") or (one.translate(_LOWER) in _LINKS and _name(two)) or (_name(token) and core.translate(_LOWER) != _name(token)))


def _capitals(token: str, core: str) -> bool:
    return len(token) >= 12 and core.isupper() and core.isalnum()


def training_table(n: int = 500, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """Labelled sentences: made-up prose with personal data, secrets and harmless numbers in it."""
    r = random.Random(seed)

    def word() -> str:
        x = "".join(r.choice(["an", "er", "th", "ou", "re", "sch", "ué", "ción", "lo", "mi", "ta", "ge", "st"]) for _ in range(r.randint(1, 4)))
        return r.choice([x, x, x, x.capitalize(), x + ",", x + "."])

    def draw(chars: str, k: int) -> str:
        return "".join(r.choice(chars) for _ in range(k))

    hexes, digits, capitals, mixed = "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    cues = ["password", "token", "secret", "api_key", "key", "passwd", "auth"]

    def slot() -> list[tuple[str, str]]:
        cue, secret = r.choice(cues), r.choice([draw(hexes, r.choice([16, 18, 18, 24, 32, 40])), draw(mixed, r.choice([20, 32, 40]))])
        kind = r.randint(0, 24)
        if kind <= 1:
            return [(f"{cue}={secret}", "secret")]
        if kind <= 3:
            return [(cue, "O"), ("=", "O"), (f'"{secret}"' + r.choice(["", "", "", ".", "###", "&&&"]), "secret")]
        if kind == 4:
            return [(f"{cue}:", "O"), (secret, "secret")]
        if kind <= 7:
            return [("AKIA" + draw(capitals, 16), "secret")]
        if kind == 8:
            return [(f"{word().strip('.,').lower()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", "email")]
        if kind == 9:
            return [(".".join(str(r.randint(0, 255)) for _ in range(4)), "ip")]
        if kind == 10:
            return [(draw(digits, r.choice([14, 15, 16, 16, 19])), "card")]
        if kind == 11:
            return [("+1", "phone"), (f"({draw(digits, 3)})", "phone_next"), (f"{draw(digits, 3)}-{draw(digits, 4)}", "phone_next")]
        if kind == 12:
            return [(r.choice(["Version", "version", "Section", "page", "BY-NC"]), "O"), (r.choice(["2.0.", "3.", "4.0.", "3.1", "12", str(r.randint(1, 2100))]), "O")]
        if kind == 13:
            return [(r.choice([str(r.randint(1, 99999)), f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}", f"{r.randint(1, 99)}%", f"v{r.randint(1, 9)}.{r.randint(0, 9)}", f"x{r.randint(1, 9)}"]), "O")]
        if kind == 14:
            return [(r.choice(["a", "x", "n", "size"]), "O"), ("=", "O"), (str(r.randint(0, 5000)), "O")]
        if kind <= 17:  # letters only; in small ones after the names that prose seldom has before a colon
            letters = r.choice([draw(mixed[:52], r.choice([12, 16, 20, 32])), draw(mixed[26:52], r.choice([10, 14, 20])), "".join(word().lower().strip(".,") for _ in range(6))[:r.randint(10, 24)]])
            name, mark = r.choice([x for x in cues if x != "key"] if letters.islower() else cues), r.choice(["", "", '"', "'"])
            value = f"{mark}{letters}{mark}" + r.choice(["", "", ".", "###"])
            return r.choice([
                [(f"{name}:", "O"), (value, "secret")], [(f"{name}:", "O"), (value, "secret")], [(r.choice(["", "{"]) + f'"{name}":', "O"), (f'"{letters}"' + r.choice(["", ",", "}", "},"]), "secret")], [(name, "O"), ("=", "O"), (value, "secret")],
                [(name, "O"), (":", "O"), (value, "secret")], [(f"{name}=", "O"), (value, "secret")], [(f"{name}:{value}", "secret")], [(f"{name}={value}", "secret")], [(name, "O"), ("is", "O"), (f'"{letters}"', "secret")],
            ])
        if kind == 18:
            mark = r.choice(["", '"', "'"])
            return [(f"{mark}AKIA{draw(capitals[:26], 16)}{mark}" + r.choice(["", ".", "###", "&&&"]), "secret")]
        if kind <= 20:  # names in prose
            name, plain, long, short = r.choice(cues), word(), "".join(word().lower().strip(".,") for _ in range(4))[: r.randint(6, 16)], r.choice(["a", "the", "none", "or", "er", "this", "que", "und"])
            return r.choice([[(name, "O"), (plain, "O")], [(name, "O"), (plain, "O")], [(name, "O"), ("is", "O"), (plain, "O")], [(f"{name}:", "O"), (short, "O"), (plain, "O")], [("key:", "O"), (plain, "O")], [("key:", "O"), (long, "O")], [(name, "O"), ("is", "O"), (long, "O")], [(r.choice(["a", "x", "n", "size"]), "O"), ("=", "O"), (plain, "O")]])
        return [("".join(word().upper().strip(".,") for _ in range(r.randint(1, 4))) + r.choice(["!!", "", ".", ",!!"]), "O") for _ in range(4)]

    out = []
    for _ in range(n):
        pairs = [(word(), "O") for _ in range(r.randint(0, 4))]
        for _ in range(r.randint(1, 2)):
            pairs += slot() + [(word(), "O") for _ in range(r.randint(0, 4))]
        out.append(([t for t, _ in pairs], [x for _, x in pairs]))
    return out


class Field:
    """Weights of features and transitions."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.weights, self.moves = np.zeros((FEATURES, n)), np.zeros((n, n))
        self.barred = np.zeros((n, n))
        nxt = LABELS.index("phone_next")
        self.barred[[i for i, x in enumerate(LABELS) if x not in ("phone", "phone_next")], nxt] = -1e4

    def _padded(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature ids of the training table, their mask and whether a place is closed to labels."""
        ids = [_feature_ids(s) for s in sentences]
        longest, most = max(map(len, ids)), max(len(f) for s in ids for f in s)
        features = np.zeros((len(ids), longest, most), np.int32)
        there = np.zeros(features.shape, bool)
        closed = np.ones(features.shape[:2], bool)
        for b, s in enumerate(ids):
            for t, f in enumerate(s):
                features[b, t, : len(f)] = f
                there[b, t, : len(f)] = True
            closed[b, : len(s)] = _closed(sentences[b])
        return features, there, closed

    def _scores(self, batch: tuple) -> np.ndarray:
        features, there, closed = batch
        out = np.zeros((*closed.shape, len(LABELS)))
        for f in range(features.shape[2]):
            out += self.weights[features[..., f]] * there[..., f, None]
        out[..., 1:] += np.where(closed, -1e4, 0)[..., None]
        out[:, 0, LABELS.index("phone_next")] += -1e4
        return out

    def fit(self, table: list[tuple[list[str], list[str]]], rounds: int = 60, rate: float = 0.3, l2: float = 1e-3) -> None:
        """Adagrad on the log likelihood, by forward and backward sums over all sentences at once."""
        batch = self._padded([t for t, _ in table])
        features, there, _ = batch
        lengths = np.array([len(t) for t, _ in table])
        n_b, n_t = features.shape[:2]
        gold = np.zeros((n_b, n_t), np.int64)
        for b, (_, labels) in enumerate(table):
            gold[b, : len(labels)] = [LABELS.index(x) for x in labels]
        real = np.arange(n_t) < lengths[:, None]
        n = len(LABELS)
        sums = [np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)]
        for _ in range(rounds):
            e, m = self._scores(batch), self.moves + self.barred
            fwd, bwd = np.empty_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, n_t):
                step = np.logaddexp.reduce(fwd[:, t - 1, :, None] + m, axis=1) + e[:, t]
                fwd[:, t] = np.where(real[:, t, None], step, fwd[:, t - 1])
            for t in range(n_t - 2, -1, -1):
                step = np.logaddexp.reduce(m + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
                bwd[:, t] = np.where(real[:, t + 1, None], step, 0)
            total = np.logaddexp.reduce(fwd[:, -1], axis=1)
            p = np.exp(fwd + bwd - total[:, None, None]) * real[..., None]
            g = -p
            np.put_along_axis(g, gold[..., None], np.take_along_axis(g, gold[..., None], 2) + real[..., None], 2)
            gw = np.zeros_like(self.weights)
            np.add.at(gw, features[there], np.broadcast_to(g[:, :, None, :], (*features.shape, n))[there])
            gm = np.zeros_like(self.moves)
            for t in range(1, n_t):
                pair = np.exp(fwd[:, t - 1, :, None] + m + (e[:, t] + bwd[:, t])[:, None, :] - total[:, None, None]) * real[:, t, None, None]
                gm -= pair.sum(0)
                np.add.at(gm, (gold[:, t - 1][real[:, t]], gold[:, t][real[:, t]]), 1)
            for x, grad, s in ((self.weights, gw, sums[0]), (self.moves, gm, sums[1])):
                grad = grad - l2 * n_b * x
                s += grad**2
                x += rate * grad / np.sqrt(s)

    def _emissions(self, sentence: list[str]) -> np.ndarray:
        """A row of label scores for each token; STEP tokens at a time, each with its neighbours."""
        out = []
        for lo in range(0, len(sentence), STEP):
            hi, before = min(len(sentence), lo + STEP), max(0, lo - 2)
            part = _feature_ids(sentence[before : hi + 1])[lo - before : hi - before]
            starts = np.cumsum([0, *map(len, part[:-1])])
            out.append(np.add.reduceat(self.weights[np.concatenate([np.array(x, np.int32) for x in part])], starts))
        return np.concatenate(out)

    def decode(self, sentences: list[list[str]]) -> list[list[int]]:
        """Best labels of each sentence.

        A closed token is O in every path, so the best path falls apart there: only the runs of open tokens between
        closed ones go through Viterbi, in batches of at most CELLS padded places (a longer run is a batch of its own).
        """
        out: list[list[int]] = [[0] * len(s) for s in sentences]
        runs: list[tuple[int, int, int, bool, bool, np.ndarray]] = []  # sentence, range, closed before and after, scores
        held = 0
        for i, sentence in enumerate(sentences):
            closed = np.array(_closed(sentence), bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[True], closed, [True]])))
            if not len(edge):
                continue
            scores = self._emissions(sentence)
            for lo, hi in edge.reshape(-1, 2).tolist():
                runs.append((i, lo, hi, lo > 0, hi < len(sentence), scores[lo:hi]))
                held += hi - lo
            if held > CELLS:
                self._viterbi(runs, out)
                runs, held = [], 0
        self._viterbi(runs, out)
        return out

    def _viterbi(self, runs: list[tuple], out: list[list[int]]) -> None:
        m, n = self.moves + self.barred, len(LABELS)
        runs.sort(key=lambda r: r[1] - r[2])
        lo = 0
        while lo < len(runs):
            longest = runs[lo][2] - runs[lo][1]
            part = runs[lo : lo + max(1, CELLS // longest)]
            lo += len(part)
            size = np.array([r[2] - r[1] for r in part])
            e = np.zeros((longest, len(part), n))
            for b, r in enumerate(part):
                e[: size[b], b] = r[5]
            before, after = (np.array([r[k] for r in part]) for k in (3, 4))
            best = e[0] + np.where(before[:, None], m[0], 0)
            best[~before, LABELS.index("phone_next")] -= 1e4
            back = np.zeros((longest, len(part), n), np.int8)
            for t in range(1, longest):
                live = int((size > t).sum())  # longer runs stand first
                step = best[:live, :, None] + m
                back[t, :live] = step.argmax(1)
                best[:live] = step.max(1) + e[t, :live]
            at = (best + np.where(after[:, None], m[:, 0], 0)).argmax(1)
            for t in range(longest - 1, -1, -1):
                live = int((size > t).sum())
                for b in range(live):
                    out[part[b][0]][part[b][1] + t] = int(at[b])
                at[:live] = back[t, np.arange(live), at[:live]]


def _closed(sentence: list[str]) -> list[bool]:
    return [not open_to_labels(*sentence[max(0, t - 2) : t + 1][::-1]) for t in range(len(sentence))]


_SECRET = LABELS.index("secret")
_SMALL = np.zeros(256, bool)
_SMALL[range(0x61, 0x7B)] = True
_GOES_ON = (np.arange(256) & 0xC0) == 0x80
_TRIGGER = np.zeros(256, bool)
_TRIGGER[list(b"0123456789=@")] = True


def _value(token: str) -> tuple[int, int]:
    """The part of a token that is the secret itself."""
    lo = token.find("=") + 1 if "=" in token.rstrip("=") else token.find(":") + 1 if _name(token) else 0
    hi = len(token)
    while lo < hi and not token[lo].isalnum():
        lo += 1
    while hi > lo and not token[hi - 1].isalnum():
        hi -= 1
    return lo, hi


def _windows(words: w.Words) -> list[tuple[int, int, int]]:
    """Document and range of words around those that may carry a label: two before, one after, merged if they meet.

    Whatever open_to_labels() opens is inside: tokens with a mark, capitals, and after an equals sign or a name the
    token itself and the next two of the same document. So a label depends on the text alone.
    """
    if not len(words.start):
        return []
    marks = np.concatenate([[0], np.cumsum(_TRIGGER[words.data])])
    small = np.concatenate([[0], np.cumsum(_SMALL[words.data])])
    may = marks[words.end] > marks[words.start]
    for i in np.flatnonzero(~may & (words.end - words.start >= 12) & (small[words.end] == small[words.start])).tolist():  # capitals of any script have no small ASCII letter
        token = words.data[words.start[i] : words.end[i]].tobytes().decode()
        may[i] = _capitals(token, token[slice(*_value(token))])
    leads = words.data[words.end - 1] == ord("=")
    raw, doc = words.data.tobytes().lower(), words.doc
    named = np.array([m.start() for m in _NAMED.finditer(raw)], np.int64)
    leads[np.searchsorted(words.start, named, "right") - 1] = True
    some = words.first[:-1] < words.first[1:]
    for i in np.unique(np.concatenate([words.first[:-1][some], words.first[1:][some] - 1])).tolist():  # the bytes beside a text's first and last word belong to others
        leads[i] |= _NAMED.search(raw[words.start[i] : words.end[i]]) is not None
    may |= leads
    for step in (1, 2):
        may[step:] |= leads[:-step] & (doc[step:] == doc[:-step])
    at = np.flatnonzero(may)
    doc = doc[at]
    out: list[tuple[int, int, int]] = []
    for i, d in zip(at.tolist(), doc.tolist(), strict=True):
        lo, hi = max(i - 2, int(words.first[d])), min(i + 2, int(words.first[d + 1]))
        if out and out[-1][0] == d and out[-1][2] >= lo:
            out[-1] = (d, out[-1][1], hi)
        else:
            out.append((d, lo, hi))
    return out


def find(column: pa.Array, field: Field) -> dict[int, tuple[list[Span], list[Span]]]:
    """Base spans and added ones of each text that has any, by its place."""
    words = w.split(column, hashes=False)
    digits = np.concatenate([[0], np.cumsum(_TRIGGER[words.data])])
    out: dict[int, tuple[list[Span], list[Span]]] = {}
    for d in np.flatnonzero(digits[words.bounds[1:]] > digits[words.bounds[:-1]]).tolist():
        if base := base_spans(column[d].as_py()):
            out[d] = (base, [])
    windows = _windows(words)
    raw = words.data.tobytes()
    points = np.concatenate([[0], np.cumsum(~_GOES_ON[words.data], dtype=np.int32)])
    tokens = [[raw[s:e].decode() for s, e in zip(words.start[lo:hi].tolist(), words.end[lo:hi].tolist(), strict=True)] for _, lo, hi in windows]
    reach: dict[int, list[int]] = {}
    for (d, lo, _), sentence, path in zip(windows, tokens, field.decode(tokens), strict=True):
        for t in (i for i, x in enumerate(path) if x == _SECRET):
            a, b = _value(sentence[t])
            at = int(points[words.start[lo + t]] - points[words.bounds[d]])
            span = (at + a, at + b, "secret")
            base, added = out.setdefault(d, ([], []))
            if d not in reach:
                reach[d] = list(itertools.accumulate((s[1] for s in base), max, initial=0))
            if a < b and reach[d][bisect.bisect_left(base, span[1], key=lambda s: s[0])] <= span[0]:  # no base span that begins before its end reaches it
                added.append(span)
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{lo}:{hi}" for lo, hi, kind in spans)


@functools.cache
def trained() -> Field:
    """Trained once for each process."""
    field = Field()
    field.fit(training_table())
    return field


def _shared(spark: SparkSession):  # noqa: ANN202
    return spark.sparkContext.broadcast(trained())


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each document: counts by kind, digest of the base spans and all spans."""
    shared = _shared(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            whole = texts(batch.column(1))
            for lo, hi in slices(whole, SLICE_BYTES):
                found = find(whole.slice(lo, hi - lo), shared.value)
                n = hi - lo
                counts = {kind: np.zeros(n, np.int64) for kind in (*KINDS, "added")}
                sums, spans = [none] * n, [""] * n
                for d, (base, added) in found.items():
                    for _, _, kind in base:
                        counts[kind][d] += 1
                    counts["added"][d] = len(added)
                    sums[d] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    spans[d] = _joined(sorted(base + added, key=lambda s: (s[0], ORDER[s[2]], s[1])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), *map(pa.array, counts.values()), pa.array(sums), pa.array(spans)], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs_of(docs), rows, SCHEMA)


def masked(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span of the text replaced by its kind in angle brackets; n_chars follows."""
    shared = _shared(docs.sparkSession)
    schema = docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            whole = texts(batch.column(place))
            for lo, hi in slices(whole, SLICE_BYTES):
                found = find(whole.slice(lo, hi - lo), shared.value)
                part = batch.slice(lo, hi - lo)
                new = part.column(place).to_pylist()
                for d, both in found.items():
                    text, out, at = new[d], [], 0
                    for a, b, kind in sorted(both[0] + both[1], key=lambda s: (s[0], -s[1])):
                        if b > at:
                            out += [text[at:a] if a > at else "", f"<{kind.upper()}>" if a >= at else ""]
                            at = b
                    new[d] = "".join([*out, text[at:]])
                yield pa.RecordBatch.from_arrays([pa.array(new, part.column(i).type) if i == place else part.column(i) for i in range(part.num_columns)], batch.schema.names)

    out = map_arrow(docs, rows, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
