"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A small parser turns a page into its leaf blocks of text with their ancestors.
The field has two states (main text or not), features of the ancestors' tags and
names and of the text, and weights for neighbouring states. It is trained by
gradient ascent on the likelihood (forward-backward) of labelled pages: layouts
with labelled blocks, filled with texts of sampled pages, and those pages
themselves where their markup names the article. Pages are decoded by Viterbi.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.llm.common import with_workers
from agrolith.llm.layouts import LAYOUTS

#: Bounds of the training sample: pages, characters of a page, and blocks of a run; longer pages train as several runs.
TRAIN_PAGES, TRAIN_CHARS, TRAIN_RUN = 120, 1 << 20, 256
STEPS = 120

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template noscript iframe svg head-only".split()) - {"head-only"}
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot
th thead tr ul""".split())
#: An opening tag ends the nearest open element of these names, unless one of the fences lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCK - {"body", "html", "head", "label", "button", "option", "td", "th", "tr", "tbody", "caption", "legend"}
P_FENCE = {"td", "th", "table", "button", "object", "caption"}
STRUCTURE = frozenset("article main nav footer header aside form section table ul ol blockquote figure pre address dialog button label select td li p body".split())
#: Words of class, id and role names, in four languages.
HINTS = {
    "nav": "nav navbar navigation topnav menu breadcrumb breadcrumbs pagination pager toc hauptmenue hauptnavigation brotkrumen inhaltsverzeichnis "
           "sommaire ariane navegacion migas indice",
    "head": "header masthead topbar logo kopf kopfzeile entete cabecera encabezado",
    "foot": "footer colophon copyright fuss fusszeile impressum pied piedpage pie piepagina",
    "side": "sidebar aside widget related recommended popular trending seitenleiste verwandte empfohlen laterale similaires lateral relacionados recomendados",
    "notice": "cookie cookies consent notice notices alert banner popup modal gdpr dialog disclaimer hinweis hinweise einwilligung avis avertissement "
              "consentement aviso avisos consentimiento",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion anzeige anzeigen werbung publicite pub annonce publicidad anuncio anuncios "
          "patrocinado",
    "form": "form login signup subscribe newsletter search register formular anmeldung suche formulaire inscription recherche formulario registro busqueda boletin",
    "comment": "comment comments commentlist reply replies discussion disqus respond responses kommentar kommentare antwort antworten commentaire commentaires "
               "reponse reponses comentario comentarios respuesta respuestas",
    "share": "share social sharing follow teilen partager partage compartir",
    "body": "article content post entry main story text body artikel inhalt beitrag contenu texte contenido articulo noticia entrada",
}
_HINT_OF = {w: g for g, ws in HINTS.items() for w in ws.split()}
#: Looked for in lower-cased text.
_PHRASES = {
    "rights": re.compile(r"©|all rights reserved|copyright|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|"
                         r"\blast (changed|updated|modified)|zuletzt (geändert|aktualisiert)|dernière (modification|mise à jour)|última (modificación|actualización)"),
    "cookies": re.compile(r"\bcookies?\b|privacy policy|terms of|datenschutz|nutzungsbedingungen|politique de confidentialité|política de privacidad|aviso legal"),
    "signup": re.compile(r"subscribe|newsletter|sign up|log ?in|register|abonnieren|anmelden|abonnez-vous|inscrivez-vous|suscríb[ea]|regístr[ea]|iniciar sesión"),
    "answer": re.compile(r"\brepl(y|ies)\b|\bcomments?\b|\bsays:|posted by|\bantworten\b|\bkommentare?\b|\bschrieb:|\brépondre\b|\bcommentaires?\b|"
                         r"\ba dit ?:|\bresponder\b|\bcomentarios?\b|\bdice:"),
    "share": re.compile(r"\bshare\b|\bfollow us|read more|related|\bteilen\b|folgen sie uns|weiterlesen|\bpartager\b|suivez-nous|lire la suite|"
                        r"\bcompartir\b|síguenos|leer más"),
}
#: Every phrase holds one of these.
_PARTS = {
    "rights": ("©", "reserved", "copyright", "vorbehalten", "réservés", "reservados", "last ", "zuletzt", "dernière", "última"),
    "cookies": ("cookie", "privacy", "terms of", "datenschutz", "nutzungsb", "confidential", "privacidad", "aviso legal"),
    "signup": ("subscribe", "newsletter", "sign up", "login", "log in", "register", "abonn", "anmelden", "inscrivez", "suscr", "regístr", "iniciar"),
    "answer": ("repl", "comment", "says:", "posted by", "antworten", "komment", "schrieb:", "répondre", "a dit", "responder", "comentario", "dice:"),
    "share": ("share", "follow us", "read more", "related", "teilen", "folgen sie", "weiterlesen", "partager", "suivez", "lire la", "compartir", "síguenos", "leer más"),
}
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_WORD = re.compile("[a-z]+")
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)


class Open:
    """An open element with what its path says: made once when it opens, so that a block needs no walk up."""

    __slots__ = ("tag", "tags", "hints", "own", "near", "marked", "named")

    def __init__(self, tag: str, hints: frozenset, marked: bool, up: Open | None):
        self.tag = tag
        self.tags = (up.tags if up else frozenset()) | ({tag} & STRUCTURE)
        self.hints = (up.hints if up else frozenset()) | hints
        self.own = tag if tag in BLOCK else up.own if up else "none"
        self.near = min(hints) if hints else up.near if up else "none"
        self.marked = marked or bool(up and up.marked)                       # labelled main text
        self.named = bool(hints - {"body"}) or bool(up and up.named)          # some name of another part


TOP = Open("", frozenset(), False, None)


@dataclass
class Block:
    text: str
    path: Open   # the innermost open element
    linked: int  # characters inside links


def parse(page: str) -> list[Block]:
    """The leaf blocks of text in page order."""
    blocks: list[Block] = []
    stack: list[Open] = []
    still: Counter = Counter()  # open elements by tag
    parts: list[str] = []
    linked, at, n = 0, 0, len(page)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, stack[-1] if stack else TOP, linked))
            parts.clear()
        linked = 0

    def close(depth: int):
        gone = [e.tag for e in stack[depth:]]
        if any(t in BLOCK for t in gone):
            flush()
        still.subtract(gone)
        del stack[depth:]

    def nearest(names, fence) -> int:
        if not any(still[t] > 0 for t in names):
            return -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in names:
                return i
            if stack[i].tag in fence:
                break
        return -1

    while at < n:
        lt = page.find("<", at)
        piece = page[at:lt if lt >= 0 else n]
        if piece:
            if not (stack and stack[-1].tag == "head"):
                parts.append(piece)
                if still["a"] > 0:
                    linked += len(piece)
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
            continue
        m = _TAG.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag, attrs = (m[1] or m[3]).lower(), m[2] if m[1] else m[4]
        if page[lt + 1] == "/":
            i = nearest({tag}, ())
            if i >= 0:
                close(i)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            if tag not in ("svg",):
                parts.append(" ") if parts else None
            continue
        if tag == "br":
            parts.append(" ")
        if tag in ENDS_P:
            i = nearest({"p"}, P_FENCE)
            if i >= 0:
                close(i)
        if tag in ENDS:
            i = nearest(*ENDS[tag])
            if i >= 0:
                close(i)
        if tag == "body":
            i = nearest({"head"}, ())
            if i >= 0:
                close(i)
        if tag in BLOCK:
            flush()
        if tag in VOID or attrs.endswith("/"):
            continue
        names = _WORD.findall(" ".join(x.strip("\"'") for x in _NAMES.findall(attrs)).lower()) if attrs else []
        hints = frozenset(_HINT_OF[w] for w in names if w in _HINT_OF) | ({"notice"} if attrs and _HIDDEN.search(attrs) else frozenset())
        stack.append(Open(tag, hints, "data-y" in attrs, stack[-1] if stack else None))
        still[tag] += 1
    flush()
    return blocks


def _bin(x: float, edges) -> int:
    return sum(x >= e for e in edges)


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block: tags and names of its ancestors, its text, its place."""
    out = []
    for i, b in enumerate(blocks):
        tags, hints, own, near = b.path.tags, b.path.hints, b.path.own, b.path.near
        words = b.text.count(" ") + 1
        f = ["bias", f"own={own}", f"near={near}", *(f"in={t}" for t in sorted(tags & STRUCTURE)), *(f"hint={g}" for g in sorted(set(hints)))]
        if tags & {"article", "main"} or "body" in hints:
            f.append("core" + ("+" + "+".join(sorted(set(hints) - {"body"} | (tags & {"nav", "footer", "aside", "form"}))) if set(hints) - {"body"} or tags & {"nav", "footer", "aside", "form"} else ""))
        f.append(f"words={_bin(words, (2, 4, 8, 15, 30, 60))}")
        f.append(f"linked={_bin(b.linked / max(1, len(b.text)), (0.01, 0.3, 0.6, 0.9))}")
        f.append("stop" if b.text[-1] in ".!?\"”…" else "open")
        f.append(f"commas={_bin(b.text.count(','), (1, 3))}")
        low = b.text.lower() if words <= 60 else ""
        f.extend(f"says={k}" for k, p in _PHRASES.items() if any(map(low.__contains__, _PARTS[k])) and p.search(low))
        f.append(f"place={0 if i == 0 else 2 if i == len(blocks) - 1 else 1}")
        out.append(f)
    return out


@dataclass
class Field:
    """Weights: one per feature for the state "main text", and one per pair of states."""

    weights: dict[str, float] = field(default_factory=dict)
    links: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def unary(self, feats: list[list[str]]) -> list[float]:
        w = self.weights.get
        return [sum([w(x, 0.0) for x in f]) for f in feats]

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi: the most probable sequence of states."""
        if not feats:
            return []
        (l00, l01), (l10, l11) = self.links.tolist()
        u = self.unary(feats)
        a, b, back = 0.0, u[0], []
        for s in u[1:]:
            from0, from1 = a + l00 >= b + l10, a + l01 > b + l11
            a, b = (a + l00 if from0 else b + l10), (a + l01 if from1 else b + l11) + s
            back.append((0 if from0 else 1, 0 if from1 else 1))
        state = int(b > a)
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return states[::-1]

    @classmethod
    def train(cls, pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, l2: float = 0.02, rate: float = 0.15) -> Field:
        """Maximum likelihood with Adam; all runs advance together, block by block. Pages are cut into runs of TRAIN_RUN
        blocks, so the arrays grow with the blocks and not with the longest page."""
        pages = [(f[i:i + TRAIN_RUN], y[i:i + TRAIN_RUN]) for f, y in pages for i in range(0, len(f), TRAIN_RUN)]
        if not pages:
            return cls()
        index: dict[str, int] = {"": 0}
        for feats, _ in pages:
            for f in feats:
                for x in f:
                    index.setdefault(x, len(index))
        n, t = len(pages), max(len(p[0]) for p in pages)
        k = max(len(f) for p in pages for f in p[0])
        x, y, on = np.zeros((n, t, k), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
        for i, (feats, labels) in enumerate(pages):
            for j, f in enumerate(feats):
                x[i, j, : len(f)] = [index[z] for z in f]
            y[i, : len(labels)], on[i, : len(labels)] = labels, True
        theta = np.zeros(len(index) + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        gold_pair = np.zeros((2, 2))
        both = on[:, 1:]
        np.add.at(gold_pair, (y[:, :-1][both], y[:, 1:][both]), 1)
        for step in range(1, steps + 1):
            w, links = theta[:-4], theta[-4:].reshape(2, 2)
            s = np.zeros((n, t, 2))
            s[:, :, 1] = w[x].sum(axis=2)
            s[~on] = 0
            alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
            alpha[:, 0] = s[:, 0]
            for j in range(1, t):
                nxt = np.logaddexp(alpha[:, j - 1, :1] + links[0], alpha[:, j - 1, 1:] + links[1]) + s[:, j]
                alpha[:, j] = np.where(on[:, j, None], nxt, alpha[:, j - 1])
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            for j in range(t - 2, -1, -1):
                ahead = s[:, j + 1] + beta[:, j + 1]
                prv = np.logaddexp(links[:, 0] + ahead[:, :1], links[:, 1] + ahead[:, 1:])
                beta[:, j] = np.where(on[:, j + 1, None], prv, 0)
            p1 = np.where(on, np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]), 0)
            pair = np.zeros((2, 2))
            for a in (0, 1):
                for b in (0, 1):
                    e = np.exp(alpha[:, :-1, a] + links[a, b] + s[:, 1:, b] + beta[:, 1:, b] - z[:, None])
                    pair[a, b] = e[both].sum()
            grad = np.zeros_like(theta)
            grad[:-4] = np.bincount(x.ravel(), weights=np.repeat(((y - p1) * on).ravel(), k), minlength=len(index))
            grad[0] = 0
            grad[-4:] = (gold_pair - pair).ravel()
            grad = grad / n - l2 / 10 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
            theta += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        return cls({f: float(theta[i]) for f, i in index.items() if i and abs(theta[i]) > 1e-6}, theta[-4:].reshape(2, 2).copy())


def labelled(blocks: list[Block]) -> list[int]:
    return [int(b.path.marked) for b in blocks]


def from_markup(blocks: list[Block]) -> list[int] | None:
    """Labels from a page's own markup: what stands in ``article`` and in no other part; None without one."""
    def inside(b: Block) -> bool:
        tags = b.path.tags
        return "article" in tags and not tags & {"nav", "footer", "aside", "form"} and not b.path.named
    y = [int(inside(b)) for b in blocks]
    return y if any(y) else None


def training_set(pages: list[str], layouts=LAYOUTS, seed: int = 7, per_page: int = 3) -> list[tuple[list[list[str]], list[int]]]:
    """Labelled pages: sampled pages with labels from their markup, and layouts filled with their texts."""
    rng = random.Random(seed)
    parsed = [parse(p) for p in pages]
    paragraphs = [b.text for bs in parsed for b in bs if b.text.count(" ") >= 8][:4000] or ["This is a paragraph of the text, and it has some words."]
    shorts = [" ".join(b.text.split()[:4]).rstrip(".") for bs in parsed for b in bs if b.text.count(" ") >= 3][:4000] or ["A few words"]
    words = [b.text for bs in parsed for b in bs if b.text.count(" ") < 3][:4000] or ["Home"]
    out = []
    for bs in parsed:
        y = from_markup(bs)
        if y is not None:
            out.append((features(bs), y))
    esc = htmllib.escape
    for i in range(max(8, per_page * len(pages))):
        layout = layouts[i % len(layouts)]

        def fill(m):
            if m[0] == "{p}":
                text = rng.choice(paragraphs).split()
                return esc(" ".join(text[: rng.choice((6, 12, 40, 120))]).rstrip(".,") + ".")
            if m[0] == "{h}":
                return esc(" ".join(rng.choice(paragraphs).split()[: rng.randint(3, 12)]))
            if m[0] == "{l}":
                return f'<a href="/x">{esc(rng.choice(words))}</a>'
            return esc(rng.choice(shorts))
        bs = parse(re.sub(r"\{[phsl]\}", fill, layout))
        out.append((features(bs), labelled(bs)))
    return out


def extract(page: str | None, model: Field) -> str:
    blocks = parse(page or "")
    return "\n".join(b.text for b, s in zip(blocks, model.decode(features(blocks))) if s)


def fit(pages: DataFrame, id_col: str, html_col: str, train_pages: int = TRAIN_PAGES) -> Field:
    """The field trained on at most ``train_pages`` pages of at most TRAIN_CHARS characters, taken by hash of the id."""
    some = pages.where(F.col(html_col).isNotNull() & (F.length(html_col) <= TRAIN_CHARS)).select(F.col(id_col).alias("i"), F.col(html_col).alias("h"))
    order = F.xxhash64(F.col("i"), F.lit(17))
    n = max(1, some.count())
    share = min(1.0, 4.0 * train_pages / n)
    near = some.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(order, "h").limit(train_pages)
    return Field.train(training_set([r["h"] for r in near.select("h").toPandas().to_dict("records")]))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Field | None = None) -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    A null or empty page has an empty text. Pages are read whole; repeated rows
    stay; an empty table gives none; other columns are not read.
    """
    spark = pages.sparkSession
    with_workers(spark)
    sent = spark.sparkContext.broadcast(model or fit(pages, id_col, html_col))  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py(), sent.value) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=[id_col, url_col, "text", "n_chars"])

    base = pages.select(id_col, url_col, F.col(html_col).cast("string"))
    kinds = dict(base.dtypes)
    return base.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
