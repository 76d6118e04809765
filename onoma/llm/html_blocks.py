"""Main text of web pages: a recurrent network labels every block with the whole page in view.

A page is cut into leaf blocks, each with the path of tags above it. Path and words are hashed
into vectors, and a bidirectional LSTM in numpy reads the sequence of a page's blocks both ways,
so a block is judged by all others. It is trained here on pages composed at random from
the ways that sites mark articles and what surrounds them.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PATH, INNER, LEAF, WORDS, NUMBERS = 96, 64, 32, 48, 5
WIDTH = PATH + INNER + LEAF + WORDS + NUMBERS
HIDDEN = 12
#: Bounds of what is held at once: characters of pages, cells of a padded batch, rows of vectors.
CHARACTERS, CELLS, ROWS = 4_000_000, 32_768, 4096

# Element names of the HTML standard.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul xmp".split())
RAW = set("script style iframe noembed noframes svg".split())
ALONE = set("hr".split())
HOLDERS = set("article aside body div dialog fieldset footer form head header html main nav section table".split())
ENDS_P = BLOCKS - set("button caption dd dt legend li object optgroup option select tbody td tfoot th thead tr title head body html template noscript".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

# a quote opens a value only behind an equals sign, and one that is never closed runs to the end
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)>?""", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
Block = tuple[tuple[str, ...], str, float]


def blocks_of(page: str) -> list[Block]:
    """(path, text, share of its characters in links) of each leaf block with text, in page order.

    Inline tags do not part text; a line break is white space. Comments, scripts and styles have
    no text, nor have drawings that are closed. Unclosed and misplaced tags are closed as browsers do in the plain cases.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            text = " ".join(html.unescape(raw).split())
            if text:
                out.append((tuple(p for _, p in stack), text, min(1.0, linked / max(1, len(raw)))))
            held.clear()
        linked = 0

    def keep(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            if in_link:
                linked += len(text)

    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            keep(page[at:])
            break
        keep(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not m[1] and not m[3].endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else at if name == "svg" else len(page)
            continue
        if name == "br":
            keep(" ")
        elif name == "a":
            in_link = not m[1]
        elif name in BLOCKS:
            flush()
            in_link = False
            if m[1]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                continue
            if name in ENDS_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in ("button", "td", "th", "caption", "table"):
                        break
            if name in SIBLINGS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in SIBLINGS[name]:
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "menu", "dl", "table", "select"):
                        break
            if name not in ALONE:
                stack.append((name, " ".join([name, *(f".{w}" for a in NAMES.findall(m[3]) for w in (a[1] or a[2] or a[3]).lower().replace("_", "-").split())])))
    flush()
    return out


@lru_cache(100_000)
def _path_slots(step: str) -> tuple[int, ...]:
    """Slots of a tag and of its names, whole and in parts."""
    tag, *names = step.split(" ")
    parts = {tag, *names, *(f".{p}" for n in names for p in re.split(r"[^a-z]+", n[1:]) if p)}
    return tuple(sorted(zlib.crc32(p.encode()) % (PATH * INNER) for p in parts))


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row for each block of a page."""
    x = np.zeros((len(blocks), WIDTH), np.float32)
    for i, (path, text, link) in enumerate(blocks):
        row = x[i]
        for step in path:
            row[[k % PATH for k in _path_slots(step)]] = 1.0
        holder = next((p for p in reversed(path) if p.split(" ")[0] in HOLDERS), "")
        row[[PATH + k // PATH for k in _path_slots(holder)]] = 1.0
        leaf = path[-1].split(" ")[0] if path else ""
        row[PATH + INNER + zlib.crc32(leaf.encode()) % LEAF] = 1.0
        raw = text.lower().encode()
        slots = np.bincount([zlib.crc32(w) % WORDS for w in raw.split()], minlength=WORDS)
        row[-NUMBERS - WORDS : -NUMBERS] = slots / np.sqrt((slots**2).sum() + 1)
        row[-NUMBERS:] = (
            np.log1p(len(raw)) / 6,
            link,
            raw[-1:] in b".!?",
            raw.count(b" ") < 4,
            min(1.0, len(path) / 10),
        )
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """One LSTM from the first block to the last, one back, and a logistic unit on both."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {f"{n}{d}": rng.normal(0, s, shape).astype(np.float32) for d in (0, 1) for n, s, shape in (("x", 0.15, (WIDTH, 4 * HIDDEN)), ("h", 0.2, (HIDDEN, 4 * HIDDEN)), ("b", 0.0, (4 * HIDDEN,)))}
        self.p |= {"o": rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "c": np.zeros(1, np.float32)}
        for d in (0, 1):
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1.0  # gates that remember

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What blocks say to the gates of both readings, before any context: x may be any number of rows."""
        return x @ np.concatenate((self.p["x0"], self.p["x1"]), axis=1) + np.concatenate((self.p["b0"], self.p["b1"]))

    def _read(self, into: np.ndarray, mask: np.ndarray, d: int, trace: list | None = None) -> np.ndarray:
        """States of [step, page]; `trace` gets what the gradient needs of each step."""
        steps, pages, _ = into.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z = into[t, :, 4 * HIDDEN * d : 4 * HIDDEN * (d + 1)] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if trace is not None:
                trace.append((t, h, c, i, f, o, g, th))
            h, c = np.where(m, o * th, h), np.where(m, c2, c)
            out[t] = h
        return out

    def judge(self, into: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """P(article) of [step, page] by their gates; mask marks the blocks that are there."""
        both = np.concatenate([self._read(into, mask, d) for d in (0, 1)], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["c"])

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.judge(self.gates(x.reshape(-1, WIDTH)).reshape(*x.shape[:2], -1), mask)

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the blocks, and its gradient by back-propagation through both readings."""
        into, traces = self.gates(x.reshape(-1, WIDTH)).reshape(*x.shape[:2], -1), ([], [])
        both = np.concatenate([self._read(into, mask, d, traces[d]) for d in (0, 1)], axis=2)
        q = _sigmoid(both @ self.p["o"] + self.p["c"])
        n = mask.sum()
        loss = -float((np.log(np.where(y, q, 1 - q) + 1e-9) * mask).sum() / n)
        dz = (q - y) * mask / n
        grad = {"o": np.einsum("tbh,tb->h", both, dz), "c": np.array([dz.sum()])}
        for d, trace in enumerate(traces):
            dout = dz[:, :, None] * self.p["o"][d * HIDDEN : (d + 1) * HIDDEN]
            dh = dc = np.zeros(dout.shape[1:], np.float32)
            dx, dwh = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(self.p[f"h{d}"])
            for t, h, c, i, f, o, g, th in reversed(trace):
                m = mask[t][:, None]
                dh = dh + dout[t]
                dc2 = (dc + dh * o * (1 - th**2)) * m
                gates = np.concatenate((dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dh * th * o * (1 - o) * m, dc2 * i * (1 - g**2)), axis=1)
                dx[t] = gates
                dwh += h.T @ gates
                dh = gates @ self.p[f"h{d}"].T + dh * ~m
                dc = dc2 * f + dc * ~m
            grad |= {f"x{d}": x.reshape(-1, WIDTH).T @ dx.reshape(-1, 4 * HIDDEN), f"h{d}": dwh, f"b{d}": dx.sum(axis=(0, 1))}
        return loss, grad

    def fit(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, rounds: int, rate: float = 0.02) -> float:
        first, second, loss = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0.0
        for r in range(1, rounds + 1):
            loss, grad = self.gradient(x, mask, y)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                step = first[k] / (1 - 0.9**r) / (np.sqrt(second[k] / (1 - 0.99**r)) + 1e-8)
                self.p[k] = (self.p[k] - rate * step - (1e-3 * self.p[k] if k[0] in "xho" else 0)).astype(np.float32)
        return loss


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32), np.zeros((longest, len(pages)), bool)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
        mask[: len(p), i] = True
    return x, mask


class Composer:
    """Random pages with the label of each block. Articles and their surroundings share one made-up language."""

    #: Ways to mark what surrounds an article: tags, names, and words that go with them.
    AROUND = (
        ("nav", ("", "menu", "navbar", "main-nav"), "home about contact login"),
        ("div", ("menu", "nav", "navigation", "breadcrumb", "breadcrumbs", "topbar"), "home about news"),
        ("header", ("", "site-header", "masthead", "top"), "welcome search menu"),
        ("footer", ("", "site-footer", "bottom"), "copyright imprint privacy terms"),
        ("div", ("footer", "copyright", "legal"), "copyright all rights reserved"),
        ("aside", ("", "sidebar", "widget"), "popular recent posts archive"),
        ("div", ("sidebar", "widget", "related", "recommended", "trending"), "related more popular"),
        ("div", ("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored"), "buy now offer sale"),
        ("div", ("cookie", "cookies", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal"), "we use cookies accept"),
        ("section", ("newsletter", "subscribe", "share", "social", "cta"), "subscribe follow us share"),
        ("form", ("", "search", "login", "subscribe", "contact"), "email password submit search"),
        ("section", ("comments", "comment-list", "responses", "discussion", "disqus"), "reply says ago"),
        ("div", ("comments", "comment", "reader-comments", "comment-section"), "reply likes ago"),
        ("ol", ("comments", "comment-list", "commentlist"), "reply posted by"),
    )
    ARTICLE = (("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post-content"), ("section", "story"), ("div", "entry"), ("div", "main-text"))

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ung ción é ä ö que los der die und la et des".split()
        self.words = ["".join(syllables[int(k)] for k in self.rng.integers(0, len(syllables), int(n))) for n in self.rng.integers(1, 5, 4000)]

    def pick(self, xs):
        return xs[int(self.rng.integers(0, len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def prose(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high))
        words = [self.words[int(k)] for k in self.rng.integers(0, len(self.words), n)]
        words[0] = words[0].title()
        return " ".join(words) + self.pick([".", ".", ".", "", "!"])

    def open(self, tag: str, name: str) -> str:
        how = self.pick(["class", "class", "id"])
        return f'<{tag} {how}="{name}">' if name else f"<{tag}>"

    def around(self) -> list[tuple[str, int]]:
        tag, names, cue = self.pick(self.AROUND)
        name, cues = self.pick(names), cue.split()
        out = [(self.open(tag, name), -1)]
        if tag not in ("nav", "ol", "form") and self.chance(0.35):  # a line of bare text and no more
            return [*out, (self.prose(1, 30), 0), (f"</{tag}>", -1)]
        as_list = tag in ("nav", "ol") or self.chance(0.3)
        if as_list and tag != "ol":
            out.append(("<ul>", -1))
        for _ in range(int(self.rng.integers(1, 7))):
            said = self.prose(1, 4) if self.chance(0.5) else self.prose(5, 30)
            if self.chance(0.4):
                said = f"{self.pick(cues)} {said}"
            if tag in ("nav",) or self.chance(0.3):
                said = f'<a href="/x">{said}</a>'
            kind = "li" if as_list else self.pick(["p", "div", "span", "h3", "p", ""])
            if tag == "form" and self.chance(0.6):
                kind = self.pick(["label", "button", "option", "p", "legend"])
            out.append((f"<{kind}>{said}</{kind}>" if kind else said, 0))
            if not kind and self.chance(0.7):  # bare text is one block, whatever comes next
                break
            if kind == "span" or kind == "label":
                out.append(("<div></div>", -1))
        if as_list and tag != "ol":
            out.append(("</ul>", -1))
        return [*out, (f"</{tag}>", -1)]

    def article(self) -> list[tuple[str, int]]:
        tag, name = self.pick(self.ARTICLE)
        out = [(self.open(tag, name), -1)]
        if self.chance(0.85):
            head = f"<h1>{self.prose(3, 14)}</h1>"
            out += [("<header>", -1), (head, 1), ("</header>", -1)] if self.chance(0.15) else [(head, 1)]
        for _ in range(int(self.rng.integers(1, 8 if self.chance(0.7) else 30))):
            kind = self.pick(["p"] * 8 + ["h2", "li", "blockquote", "broken"])
            said = self.prose(1, 9) if self.chance(0.35) else self.prose(8, 60 if self.chance(0.7) else 250)
            if self.chance(0.1):
                said += f' <a href="/y">{self.prose(1, 4)}</a>'
            if kind == "broken":
                out += [(f"<p><b>{said}<br>", 1)]
            elif kind == "li":
                out += [("<ul>", -1), (f"<li>{said}</li>", 1), ("</ul>", -1)]
            else:
                out.append((f"<{kind}>{said}</{kind}>", 1))
            if self.chance(0.06):
                out += self.around()
        return [*out, (f"</{tag}>", -1)]

    def page(self) -> tuple[str, list[int]]:
        """A page, and the label of each piece that holds a block, in order."""
        body = [("<head>", -1), (f"<title>{self.prose(3, 12)}</title>", 0), ("<style>p{}</style><script>var a='</p>';</script></head><body>", -1)]
        wrap = self.chance(0.4)
        if wrap:
            body.append((self.open("div", self.pick(["page", "wrapper", "container", "site"])), -1))
        for _ in range(int(self.rng.integers(1, 4))):
            body += self.around()
        if self.chance(0.95):
            body += self.article()
        for _ in range(int(self.rng.integers(0, 3)) if self.chance(0.8) else 0):
            body += self.around()
        if self.chance(0.8):
            tag, name = self.pick([("footer", ""), ("footer", "site-footer"), ("div", "footer")])
            body += [(self.open(tag, name), -1), (f"&copy; {self.prose(2, 20)}", 0), (f"</{tag}>", -1)]
        body.append(("</body>", -1))
        return "".join(t for t, _ in body), [y for _, y in body if y >= 0]


def composed(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Pages whose blocks pair with their labels; those where pieces merged into one block are left out."""
    make, out = Composer(seed), []
    while len(out) < n:
        page, labels = make.page()
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            out.append((blocks, labels))
    return out


@lru_cache(1)
def trained(pages: int = 900, rounds: int = 110, seed: int = 11) -> Labeller:
    """The network fitted on composed pages; the same for each call, as all draws are seeded."""
    made = composed(pages, seed)
    x, mask = padded([vectors(b) for b, _ in made])
    y = np.zeros(mask.shape, bool)
    for i, (_, labels) in enumerate(made):
        y[: len(labels), i] = labels
    model = Labeller()
    model.fit(x, mask, y, rounds)
    return model


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """P(article) of the blocks of each page; pages of like length are read together, as many as CELLS allows.

    Vectors are made for some rows at a time and turned to gates at once, so what a page needs is
    some 400 bytes a block, however long it is.
    """
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        some = [order[at]]
        most = len(pages[some[0]]) * 5 // 4 + 4
        while at + len(some) < len(order) and len(pages[order[at + len(some)]]) <= min(most, CELLS // (len(some) + 1)):
            some.append(order[at + len(some)])
        gates = [np.concatenate([model.gates(vectors(pages[i][lo : lo + ROWS])) for lo in range(0, len(pages[i]), ROWS)]) for i in some]
        p = model.judge(*padded(gates))
        for k, i in enumerate(some):
            out[i] = p[: len(pages[i]), k]
        at += len(some)
    return out


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of up to CHARACTERS in all, one row at least."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > CHARACTERS:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _extract(model: Labeller, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _parts(sizes):
                b = batch.slice(lo, hi - lo)
                pages = [blocks_of(x or "") for x in b.column("html").to_pylist()]
                texts = ["\n".join(text for (_, text, _), q in zip(page, p, strict=True) if q >= 0.5) for page, p in zip(pages, label(model, pages), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*columns, "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html, ...).

    text has the blocks labelled as article, joined by line feeds; it is empty for a null or empty
    page and for one without an article. One pass without a shuffle; repeated rows are read each, and an
    empty table gives no rows. Other columns are not read, whatever their names. Pages are read in
    groups bounded by characters and blocks; a very long one is a group of its own.
    """
    columns = ["page_id", "url"]
    read = pages.select(*columns, "html")
    schema = read.select(*columns).schema.add("text", "string").add("n_chars", "long")
    return read.mapInArrow(_extract(trained(), columns), schema)
