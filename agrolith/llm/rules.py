"""Line-first quality rules.

Each line is judged by itself (symbols, shouting, navigation, boilerplate,
repeats, missing punctuation); failing lines are removed, and a document that
loses too much of its text is rejected. Base measures of the whole text reject
very short and self-repeating documents first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.llm.common import with_workers

SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8
#: A document stays if the lines it loses hold at most this share of its word characters.
MAX_LOSS = 0.4
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Words of menus, in the four languages of the corpus.
NAV_WORDS = frozenset("""
home menu login logout register search next previous prev back top share tweet contact about help sitemap rss print email more
startseite kontakt anmelden abmelden registrieren suche suchen hilfe impressum datenschutz weiter zurück oben teilen drucken mehr warenkorb übersicht
accueil connexion déconnexion inscription recherche rechercher aide suivant précédent retour partager imprimer plus panier plan site
inicio contacto acceder entrar salir registrarse registro buscar búsqueda ayuda siguiente anterior volver arriba compartir imprimir más mapa carrito
""".split())
#: Small words that join menu words ("contact us", "plan du site"); a menu has no more of them than of menu words.
NAV_JOINS = frozenset("& us the and to und uns nach et nous du de la le en haut y el del".split())
#: Phrases of notices, in the four languages of the corpus.
BOILERPLATE = re.compile("|".join((
    r"all rights reserved|cookie policy|accept (all )?cookies|privacy policy|terms of (use|service)|click here|subscribe to our",
    r"enable javascript|sign up for|lorem ipsum",
    r"alle rechte vorbehalten|cookie-richtlinien?|alle (cookies )?akzeptieren|datenschutzerklärung|nutzungsbedingungen|hier klicken|klicken sie hier",
    r"abonnieren sie unseren|javascript aktivieren|aktivieren sie javascript",
    r"tous droits réservés|politique de cookies|accepter (tous )?les cookies|tout accepter|politique de confidentialité|conditions d['’]utilisation",
    r"mentions légales|cliquez ici|abonnez-vous à (notre|la)|activez javascript|activer javascript|inscrivez-vous à (notre|la)",
    r"todos los derechos reservados|política de cookies|aceptar (todas )?las cookies|aceptar todo|política de privacidad|condiciones de uso|aviso legal",
    r"ha(ga|z) clic aquí|suscríbe(te|se) a nuestr[oa]|active javascript|activar javascript|regístrese en")), re.IGNORECASE)
NAV_ANY = NAV_WORDS | NAV_JOINS | {""}
SEPARATORS = ".,:|>-·•»/"
#: Marks that stand by themselves between the entries of a menu, in any language.
BETWEEN = frozenset("| / · • » › > → ::".split())
SENTENCE = re.compile(r"(?<=[.!?;])\s+")
#: Every phrase holds one of these, in lower case.
NOTICE_PARTS = ("reserved", "cookie", "privacy policy", "terms of", "click here", "subscribe to", "javascript", "sign up for", "lorem ipsum",
                "vorbehalten", "akzeptieren", "datenschutz", "nutzungsb", "klicken", "abonnieren sie", "tous droits", "accepter", "confidential",
                "conditions d", "mentions l", "cliquez ici", "vous à", "reservados", "privacidad", "aceptar todo", "condiciones de uso", "aviso legal",
                "clic aqu", "suscríbe", "regístrese")
#: A line or sentence is a notice if boilerplate phrases fill at least one word in this many.
NOTICE_WORDS = 12.5
#: Punctuation marks; not those inside a word or a number (don't, 3.14, 10:30).
MARKS = re.compile(r"(?:[!?;…)\]]|,(?!\d)|[.:\"'](?!\w))+")
#: Prose has a mark in so many words, and fewer than LAST_WORDS behind the last one.
MARK_WORDS = 40
LAST_WORDS = 20


@dataclass
class Judged:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    lost_chars: int
    text: str


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more (the first included)."""
    m = len(words) - window + 1
    if m < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    h = np.zeros(m, np.uint64)
    u = ids.astype(np.uint64)
    for j in range(window):
        h = h * _PRIME + u[j:j + m] + np.uint64(1)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0  # equal windows have equal hashes
    maybe = np.zeros(m, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)
    rows = np.stack([ids[at + j] for j in range(window)], axis=1)
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[counts[inverse.reshape(-1)] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def notice(line: str, n: int) -> bool:
    """Whether boilerplate phrases fill their share of the line, or of sentences that make half of it."""
    def filled(text: str) -> int:
        return sum(len(m[0].split()) for m in BOILERPLATE.finditer(text))

    low = line.lower()
    if not any(map(low.__contains__, NOTICE_PARTS)) and not any(map(line.__contains__, "İıſ")):
        return False  # the pattern's folding of case knows three letters more than lower()
    found = filled(line)
    if not found or found * NOTICE_WORDS >= n:
        return found > 0
    sentences = [(len(x.split()), filled(x)) for x in SENTENCE.split(line)]
    return 2 * sum(m for m, f in sentences if f and f * NOTICE_WORDS >= m) >= n


def navigation(words: list[str]) -> bool:
    """Menu words with no more small words than those, or three and more marks between entries of two words on average."""
    if all(w.strip(SEPARATORS).lower() in NAV_ANY for w in words):
        bare = [w.strip(SEPARATORS).lower() for w in words]
        menu = sum(map(NAV_WORDS.__contains__, bare))
        return 0 < menu >= sum(map(NAV_JOINS.__contains__, bare))
    marks = sum(map(BETWEEN.__contains__, words))
    return marks >= 3 and marks <= len(words) - marks <= 2 * (marks + 1) and words[-1][-1] not in ".!?"


def unmarked(line: str, n: int) -> bool:
    """Whether a line has fewer marks than one in MARK_WORDS words, none at all, or LAST_WORDS words behind the last."""
    ends = [m.end() for m in MARKS.finditer(line)]
    return not ends or len(ends) < n // MARK_WORDS or len(line[ends[-1]:].split()) >= LAST_WORDS


def fails(line: str, words: list[str], chars: int) -> bool:
    """Whether a line is removed; ``chars`` counts its characters in words."""
    n = len(words)
    symbols = sum(map(line.count, SYMBOLS))
    if symbols * 20 > chars and symbols > 2:
        return True  # noise of symbols, or cells of a table or menu
    if line.count("!!") * 3 > n or (n >= 5 and chars > 20 and line == line.upper() and line != line.lower()):
        return True  # shouting
    if navigation(words):
        return True
    if notice(line, n):
        return True
    if n >= 10 and 3 * sum(map(str.__eq__, words, words[1:])) > n:
        return True  # words said again at once
    if n >= 20:
        if unmarked(line, n):
            return True  # a long line without the punctuation of prose
        if Counter(words).most_common(1)[0][1] * 3 > n:
            return True  # one word over and over
    return False


def judge(text: str | None) -> Judged:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dups, lost, kept_lines = 0, 0, []
    for line in text.split("\n"):
        parts = line.split()
        bare = line.strip("\t\x0b\x0c\r ")
        if not bare:
            kept_lines.append(line)
            continue
        chars = len(line) - sum(map(line.count, SPACES))
        if line in seen:
            dups += 1
            lost += chars
            continue
        seen.add(line)
        if fails(line, parts, chars):
            lost += chars
        else:
            kept_lines.append(line)
    repeat = repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PCT * n_words
    kept = not base_failed and lost <= MAX_LOSS * word_chars
    return Judged(n_words, word_chars, n_symbols, dups, repeat, base_failed, kept, lost, "\n".join(kept_lines))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, base measures, base_failed, kept, lost_chars.

    A null text counts as one without words and fails the base rules, as an
    empty one does. Texts are read whole; repeated rows stay; an empty table
    gives none; other columns are not read.
    """
    with_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(t.as_py()) for t in b.column(1)]
            ints = [pa.array([getattr(g, c) for g in got], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *ints, pa.array([g.base_failed for g in got], pa.bool_()), pa.array([g.kept for g in got], pa.bool_()),
                 pa.array([g.lost_chars for g in got], pa.int64())],
                names=["__id", *COUNTS, "base_failed", "kept", "lost_chars"])

    base = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = base.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, lost_chars bigint"
    return base.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def clean(df: DataFrame, text_col: str) -> DataFrame:
    """The kept rows of ``df``, same columns, with the failing lines taken out of ``text_col``."""
    with_workers(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(t.as_py()) for t in b.column(at)]
            keep = pa.array([g.kept for g in got], pa.bool_())
            cols = list(b.columns)
            cols[at] = pa.array([g.text for g in got], pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema.set(at, pa.field(text_col, pa.string()))).filter(keep)

    return df.withColumn(text_col, F.col(f"`{text_col}`").cast("string")).mapInArrow(run, df.withColumn(text_col, F.lit("").cast("string")).schema)
