"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the runs of text between block-level tags. Each block is a vector of its tag path
(tags with their classes, ids and roles, hashed), its words (hashed) and a few sizes. A bidirectional LSTM in numpy
reads the vectors of a page in order, in both directions, and labels every block as article or not, so each label
rests on the whole page. It is trained here, on pages that training_pages() makes up. Text in scripts, styles,
templates, controls, frames, drawings (svg) and the head is never a block. A head without an end tag ends at the first
text or element that cannot stand in it. Tags are read by the rules of HTML: a quote counts only right after an
equals sign, a tag without its ">" takes the rest of the page with it, and a quote that never closes is an ordinary
character.

A batch of pages is bounded by its padded cells; a longer page is a batch of its own and takes memory in
proportion to its blocks.

Defined cases: null or empty html gives the empty text; equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import collections
import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as w
from tessera.llm.common import map_arrow, slices, texts

SCHEMA = "page_id long, url string, text string, n_chars long"
PATH, WORDS, SIZES, HIDDEN = 64, 32, 4, 16
WIDTH = PATH + WORDS + SIZES
SLICE_BYTES = 2 << 20
#: Padded blocks of a batch of pages.
CELLS = 1 << 14

BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template textarea select button option title head iframe svg".split())
RAW = frozenset("script style textarea title iframe noscript".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag that ends an open one of the named kinds first, up to the nearest of the others.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*')?|["'])*+)>""")
_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|</>|<(?:[!?]|/[^A-Za-z>])[^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?<![^\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")

Path = tuple[int, int]  # slots of all tags above as bits, and how many tags there are
Block = tuple[str, Path, int]  # text, path, characters in links


def blocks(page: str) -> list[Block]:
    """Text blocks in page order with the tags above them."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # tag, and the slots of it and all above it
    opened: collections.Counter[str] = collections.Counter()
    silent = links = 0
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                out.append((text, (stack[-1][1], len(stack)) if stack else (0, 0), linked))
        linked = 0

    def close(depth: int) -> None:
        nonlocal silent, links
        while len(stack) > depth:
            tag, _ = stack.pop()
            opened[tag] -= 1
            silent -= tag in SILENT
            links -= tag == "a"

    def nearest(tag: str) -> int:
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)

    def leave_head() -> None:
        while stack and stack[-1][0] == "head":
            close(len(stack) - 1)

    def say(text: str) -> None:
        nonlocal linked
        if silent and text and not text.isspace():
            leave_head()
        if text and not silent:
            pieces.append(text)
            linked += len(text) * (links > 0)

    at, said = 0, 0
    while (at := page.find("<", at)) >= 0:
        m = _TAG.match(page, at)
        if not m:
            other = _COMMENT.match(page, at)
            if other:
                say(page[said:at])
                at = said = other.end()
            elif page[at + 1 : at + 2].isalpha() and page[at + 1].isascii() or page[at + 1 : at + 2] == "/" and page[at + 2 : at + 3].isalpha():
                say(page[said:at])
                said = at = len(page)  # a tag that never ends
            else:
                at += 1
            continue
        say(page[said:at])
        at = said = m.end()
        tag = m.group(2).lower()
        if tag in BLOCK:
            flush()
        if m.group(1):
            if opened[tag]:
                close(nearest(tag))
            continue
        if tag not in IN_HEAD:
            leave_head()
        if tag == "body":
            close(next((i for i, x in enumerate(stack) if x[0] == "head"), len(stack)))
        if tag in BLOCK and tag != "br" and opened["p"]:
            close(nearest("p"))
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag][0]):
            ends, bounds = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in bounds:
                    break
                if stack[i][0] in ends:
                    close(i)
                    break
        if tag in VOID or m.group(3).endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = said = end.end() if end else len(page)
            continue
        names = " ".join(a or b or c for _, a, b, c in _NAMED.findall(m.group(3))).lower() if m.group(3) else ""
        stack.append((tag, (stack[-1][1] if stack else 0) | _path_slots(f"{tag} {names}" if names else tag)))
        opened[tag] += 1
        silent += tag in SILENT
        links += tag == "a"
    say(page[said:])
    flush()
    return out


_slots: dict[str, int] = {}


def _path_slots(part: str) -> int:
    """Slots of a tag with its names, as bits; kept, as a site repeats them."""
    if part not in _slots:
        if len(_slots) > 50_000:
            _slots.clear()
        tag, _, names = part.partition(" ")
        _slots[part] = functools.reduce(int.__or__, (1 << zlib.crc32(x.encode()) % PATH for x in (tag, *("." + x for x in _PART.findall(names)))))
    return _slots[part]


def vectors(found: list[Block]) -> np.ndarray:
    """A row for each block."""
    out = np.zeros((len(found), WIDTH), np.float32)
    words = w.split(pa.array([t for t, _, _ in found], pa.large_string()))
    slot = np.bincount(words.doc * WORDS + (words.hash & w.U(WORDS - 1)).astype(np.int64), minlength=len(found) * WORDS)
    out[:, PATH : PATH + WORDS] = np.log1p(slot.reshape(len(found), WORDS)) / 4
    bits = np.array([slots for _, (slots, _), _ in found], "<u8")
    out[:, :PATH] = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for i, (text, (_, depth), linked) in enumerate(found):
        out[i, PATH + WORDS :] = (np.log1p(len(text)) / 8, linked / len(text) if text else 0, depth / 16, text[-1] in ".!?")
    return out


# the network

NAMES = ("xf", "hf", "bf", "xb", "hb", "bb", "o", "c")


def _start(seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    p = {}
    for d in "fb":
        p[f"x{d}"] = r.normal(0, 0.15, (WIDTH, 4 * HIDDEN))
        p[f"h{d}"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        p[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    p["o"], p["c"] = r.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, real: np.ndarray, wx: np.ndarray, wh: np.ndarray, bias: np.ndarray, traced: bool) -> tuple[np.ndarray, list]:
    """Hidden states of one direction over (time, batch); places that aren't real keep the state as it is.

    The trace is what _back() needs, and is kept for training alone.
    """
    steps, batch = x.shape[:2]
    h, c = np.zeros((batch, HIDDEN), x.dtype), np.zeros((batch, HIDDEN), x.dtype)
    pre, out, trace = x @ wx + bias, np.empty((steps, batch, HIDDEN), x.dtype), []
    for t in range(steps):
        z = pre[t] + h @ wh
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        m = real[t][:, None]
        if traced:
            trace.append((h, c, i, f, o, g, new, m))
        c = np.where(m, new, c)
        h = np.where(m, o * np.tanh(new), h)
        out[t] = h
    return out, trace


def _back(x: np.ndarray, grad: np.ndarray, trace: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of one direction's weights from those of its states."""
    gx, gh, gb = np.zeros((x.shape[2], 4 * HIDDEN)), np.zeros_like(wh), np.zeros(4 * HIDDEN)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(trace) - 1, -1, -1):
        h, c, i, f, o, g, new, m = trace[t]
        dh = dh + grad[t]
        th = np.tanh(new)
        dn = np.where(m, dc + dh * o * (1 - th**2), 0)
        dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), np.where(m, dh * th, 0) * o * (1 - o), dn * i * (1 - g**2)], 1)
        gx += x[t].T @ dz
        gh += h.T @ dz
        gb += dz.sum(0)
        dh = dz @ wh.T + np.where(m, 0, dh)
        dc = np.where(m, dn * f, dc)
    return gx, gh, gb


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), WIDTH), np.float32)
    real = np.zeros(x.shape[:2], bool)
    for b, page in enumerate(pages):
        x[: len(page), b] = page
        real[: len(page), b] = True
    return x, real


def _logits(p: dict, x: np.ndarray, real: np.ndarray, traced: bool = False) -> tuple[np.ndarray, np.ndarray, list, list]:
    hf, tf = _run(x, real, p["xf"], p["hf"], p["bf"], traced)
    hb, tb = _run(x[::-1], real[::-1], p["xb"], p["hb"], p["bb"], traced)
    h = np.concatenate([hf, hb[::-1]], 2)
    return h @ p["o"] + p["c"], h, tf, tb


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 14, size: int = 40, rate: float = 0.02) -> dict[str, np.ndarray]:
    """Adam on the cross entropy of all blocks."""
    p = _start()
    data = [(vectors(b), np.array(y, float)) for b, y in pages if b]
    r = np.random.Generator(np.random.PCG64(5))
    first, second, n = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(rounds):
        order = r.permutation(len(data))
        for lo in range(0, len(order), size):
            part = [data[i] for i in order[lo : lo + size]]
            x, real = _padded([v for v, _ in part])
            y = np.zeros(real.shape)
            for b, (_, labels) in enumerate(part):
                y[: len(labels), b] = labels
            z, h, tf, tb = _logits(p, x, real, traced=True)
            dz = np.where(real, _sigmoid(z) - y, 0) / real.sum()
            dh = dz[..., None] * p["o"]
            grads = dict(zip(("xf", "hf", "bf"), _back(x, dh[..., :HIDDEN], tf, p["hf"]), strict=True))
            grads |= dict(zip(("xb", "hb", "bb"), _back(x[::-1], dh[::-1, :, HIDDEN:], tb, p["hb"]), strict=True))
            grads |= {"o": (dz[..., None] * h).sum((0, 1)), "c": dz.sum(keepdims=True).reshape(1)}
            n += 1
            for k in NAMES:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def label(p: dict[str, np.ndarray], pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block belongs to the article."""
    out = [np.zeros(len(b), bool) for b in pages]
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: -len(pages[i]))
    while order:
        n = max(1, CELLS // len(pages[order[0]]))
        part, order = order[:n], order[n:]
        z = _logits(p, *_padded([vectors(pages[i]) for i in part]))[0]
        for b, i in enumerate(part):
            out[i] = z[: len(pages[i]), b] > 0
    return out


def training_pages(n: int = 260, seed: int = 11) -> list[tuple[list[Block], list[bool]]]:
    """Made-up pages in several layouts, with a label for each block."""
    r = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice(["an", "er", "th", "ou", "re", "ei", "lo", "ca", "mi", "ta", "ge", "st"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi)))

    def sentence(lo: int = 4, hi: int = 40) -> str:
        return words(lo, hi).capitalize() + r.choice([".", ".", ".", "!", ""])

    out = []
    mark = "\u0001"
    for _ in range(n):
        def links(k: int) -> str:
            return "<ul>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

        def junk(where: str) -> str:
            kind = r.choice(where.split())
            prose = sentence(3, 30)
            return {
                "nav": f"<nav>{links(r.randint(3, 8))}</nav>",
                "menu": f'<div class="{r.choice(["menu", "navbar", "breadcrumbs", "nav links"])}">{links(r.randint(2, 6))}</div>',
                "header": f"<header><h1>{words(1, 4)}</h1><p>{prose}</p></header>",
                "footer": f"<footer>{r.choice(['&copy; ', ''])}{prose}<p>{words(2, 6)}</p></footer>",
                "foot": f'<div id="footer"><p>{prose}</p></div>',
                "ad": f'<div class="{r.choice(["ad", "ads", "advert", "banner", "sponsored", "promo"])}">{prose}</div>',
                "aside": f"<aside><h3>{words(1, 3)}</h3>{links(3)}<p>{prose}</p></aside>",
                "side": f'<div class="{r.choice(["sidebar", "related", "widget"])}"><h4>{words(1, 3)}</h4><p>{prose}</p></div>',
                "notice": f'<div class="{r.choice(["notice", "cookie", "cookie-notice", "alert", "consent", "newsletter"])}"><p>{prose}</p></div>',
                "form": f'<form action="/s"><label>{words(1, 3)}</label><input type="text"><p>{prose}</p></form>',
                "comments": f'<{(t := r.choice(["section", "div"]))} class="comments"><h3>{words(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{sentence()}</p></div>' for _ in range(r.randint(1, 4))) + f"</{t}>",
                "share": f'<div class="{r.choice(["share", "social"])}">{links(2)}</div>',
            }[kind]

        paragraphs = []
        for i in range(r.randint(1, 14)):
            tag = r.choice(["p"] * 8 + ["h2", "h3", "li", "blockquote", "td", "pre"])
            text = mark + sentence(1, 8 if tag in ("h2", "h3") else 60)
            if r.random() < 0.2:
                text = f"<b>{text}<br>" + ("" if r.random() < 0.5 else mark + sentence())
            paragraphs.append({"li": f"<ul><li>{text}</li></ul>", "td": f"<table><tr><td>{text}</td></tr></table>"}.get(tag, f"<{tag}>{text}" + ("" if tag == "p" and r.random() < 0.2 else f"</{tag}>")))
            if r.random() < 0.08:
                paragraphs.append(junk("ad aside share notice"))
        title = f"<h1>{mark}{sentence(1, 10)}</h1>"
        wrap = r.choice(["article", "article", "article", "main", "div class=content", "div id=article", "div class=post-body", "section class=entry"])
        body = f"<{wrap}>{title}{''.join(paragraphs)}</{wrap.split()[0]}>"
        top = "".join(junk("nav nav header menu ad notice") for _ in range(r.randint(0, 4)))
        end = "".join(junk("footer footer foot comments side aside form share notice ad") for _ in range(r.randint(0, 4)))
        page = f"<html><head><title>{words(1, 5)}</title></head><body>{top}{body}{end}" + r.choice(["", "</body></html>"])
        found = blocks(page)
        out.append(([(t.replace(mark, ""), path, linked) for t, path, linked in found if t != mark], [mark in t for t, _, _ in found if t != mark]))
    return out


@functools.cache
def trained() -> dict[str, np.ndarray]:
    """Trained once for each process."""
    return train(training_pages())


def main_text(pages: DataFrame) -> DataFrame:
    """One row for each page: its article's text."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts(batch.column(2))
            for lo, hi in slices(whole, SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                found = [blocks(x) for x in whole.slice(lo, hi - lo).to_pylist()]
                kept = [" ".join(b[0] for b, good in zip(page, labels.tolist(), strict=True) if good) for page, labels in zip(found, label(shared.value, found), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(kept, pa.string()), pa.array(list(map(len, kept)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").cast("string").alias("url"), F.col("`html`").cast("string").alias("html"))
    return map_arrow(own, rows, SCHEMA)
