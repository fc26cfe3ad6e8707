import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from agrolith.llm import queries, rules

SF = "/root/testdata/sf0.001"


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(runs)
    cover = set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            cover.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\t\x0b\x1c\x85\u2003|#é", max_size=120))
def test_base_measures(text):
    g = rules.judge(text)
    assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == by_hand(text)


def test_repeats_in_long_texts():
    rng = random.Random(1)
    for n in (9, 50, 3000):
        words = rng.choices("abcdef", k=n)
        text = " ".join(words)
        assert rules.judge(text).n_repeat_words == by_hand(text)[4]


CLEAN = ("The river rose in spring, and boats went up to the mill. Millers ground rye for three villages, then slept. "
         "Later a railway came; nobody rowed any more, though children still fished below the weir.")


def test_verdicts_and_cleaning(spark):
    noisy = "\n".join(["| a | b | c | d |"] * 2 + ["SHOUT!! AND!! SHOUT!! AGAIN!! AND!!"] + [" ".join(["same"] * 40)])
    rows = [(1, CLEAN), (2, CLEAN + "\nHome | Menu | Login | Search | Contact"), (3, CLEAN + "\n" + noisy * 3), (4, None), (5, ""), (6, "short text"),
            (7, "word " * 200), (1, CLEAN)]
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id bigint, text string, kept boolean")
    got = rules.apply_rules(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["kept"] for i in (1, 2, 3, 4, 5, 6, 7)] == [True, True, False, False, False, False, False]
    assert all(by[i]["base_failed"] for i in (4, 5, 6, 7)) and by[2]["lost_chars"] > 0
    kept = rules.clean(df, "text")
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, CLEAN), (1, CLEAN), (2, CLEAN)]
    assert rules.apply_rules(df.limit(0), "doc_id", "text").count() == 0 and rules.clean(df.limit(0), "text").count() == 0


def test_labelled_documents(spark):
    """Good documents stay unless the base rules fail them; nearly all poor ones go."""
    sf = "/root/testdata/sf0.01"
    got = queries.op8_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good, poor = got[(got.quality == 1) & ~got.base_failed], got[got.quality == 0]
    assert good.kept.mean() >= 0.99 and poor.kept.mean() <= 0.05


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op8_rules(spark, SF).collect():
        assert tuple(r[c] for c in (*rules.COUNTS, "base_failed")) == by_hand(texts[r["doc_id"]])


def test_one_word_over_and_over():
    """All words of a line count, wherever they stand: verdict and lost characters against plain loops."""
    rng = random.Random(3)
    for n in range(20, 60):
        for every in (2, 3, 4):
            for at in range(every):
                words = ["buy" if i % every == at else f"w{rng.randrange(10**6)}x{i}" for i in range(n)]
                words[-1] += "."
                line = ", ".join(words[:2]) + " " + " ".join(words[2:])
                words = line.split(" ")
                often = max(sum(x == y for y in words) for x in words)
                g = rules.judge(CLEAN + "\n" + line)
                assert (g.lost_chars > 0) == (often * 3 > n), line
                assert g.lost_chars == (sum(map(len, words)) if often * 3 > n else 0)
                assert g.kept == (g.lost_chars <= 0.4 * g.word_chars)


LONG_PROSE = ("The keeper of the weir wrote down the height of the water every morning and evening for thirty years, and nobody asked for the book until the bridge "
              "fell; then three engineers read it in one night, page by page, and found that the river had warned them.")
NOTICE = ("We use small files on your device to remember settings. By using this site you accept our cookie policy and privacy policy. "
          "Click here to accept all cookies or to change them in your browser, and read the terms of use before you go on.")
MENU = "Home About Contact Login Register Search Help Sitemap"
PLAIN = " ".join(f"word{i}" for i in range(60))
# line, whether it is removed
LINES = [
    (MENU, True), ((MENU + " ") * 5, True), ("Home / About / Contact", True), ("Home | Menu | Login", True), (MENU + " river", False), ("/ - /", False),
    (NOTICE, True), (NOTICE.upper().replace("WE USE", "We use"), True), ("Please read our privacy policy.", True), ("cookie policy " + "word " * 23 + "end.", True),
    (LONG_PROSE + " Only later did the town hang up a privacy policy at the mill, which no miller read.", False), (LONG_PROSE, False),
    ("Startseite Kontakt Anmelden Suche Impressum Hilfe", True), ("Accueil / Plan du site / Contact", True), ("Inicio Contacto Buscar Ayuda", True),
    ("Contact us", True), ("us and the", False), ("Zurück nach oben", True), ("Nach oben und nach unten", False), ("Das Impressum der Zeitung", False),
    ("Todos los derechos reservados.", True), ("Tous droits réservés.", True), ("Alle Rechte vorbehalten.", True), ("Alle akzeptieren", True),
    ("TOUT ACCEPTER", True), ("Wir verwenden Dateien auf Ihrem Gerät. Alle Cookies akzeptieren oder ablehnen.", True), ("Lisez notre politique de confidentialité", True),
    ("Haga clic aquí para ver más", True), ("Suscríbete a nuestro boletín", True), ("Cliquez ici", True), ("Nutzungsbedingungen", True),
    ("Der Müller las im Winter die Nutzungsbedingungen der Mühle, legte sie weg und mahlte weiter, wie es sein Vater getan hatte.", False),
    ("Sport · Wetter · Reise · Kultur", True), ("Deportes » Tiempo » Viajes » Cultura local", True), ("· · ·", False), ("Sport · Wetter · Reise", False),
    ("Er kam · sah die lange Reihe der alten Boote am Ufer · ging · und kam nie wieder zurück in die Stadt am Fluss.", False),
    (PLAIN, True), (PLAIN.replace("word0 ", "word0, "), True), (PLAIN.replace("word0 ", "don't "), True), (PLAIN + ".", False), (PLAIN + " " + PLAIN[::-1] + ".", True),
    (PLAIN.replace("word9 ", "3.14 10:30 1,000 "), True), (" ".join(PLAIN.split()[:19]), False), (" ".join(PLAIN.split()[:20]), True), ("no,spaces here " * 3 + CLEAN, False),
]


def test_lines_of_any_length():
    """Navigation, notices and punctuation are judged in lines of any length; lost characters are the lines' own."""
    for line, gone in LINES:
        g = rules.judge(CLEAN + "\n" + line)
        size = sum(map(len, line.split()))
        assert g.lost_chars == (size if gone else 0), line
        assert g.text == (CLEAN if gone else CLEAN + "\n" + line)
        assert g.kept == (g.lost_chars <= 0.4 * (size + sum(map(len, CLEAN.split()))) and not g.base_failed)


PHRASES = """all rights reserved/cookie policy/accept cookies/accept all cookies/privacy policy/terms of use/terms of service/click here/subscribe to our
enable javascript/sign up for/lorem ipsum/alle rechte vorbehalten/cookie-richtlinie/cookie-richtlinien/alle akzeptieren/alle cookies akzeptieren/datenschutzerklärung
nutzungsbedingungen/hier klicken/klicken sie hier/abonnieren sie unseren/javascript aktivieren/aktivieren sie javascript/tous droits réservés/politique de cookies
accepter les cookies/accepter tous les cookies/tout accepter/politique de confidentialité/conditions d'utilisation/conditions d’utilisation/mentions légales
cliquez ici/abonnez-vous à notre/abonnez-vous à la/activez javascript/activer javascript/inscrivez-vous à notre/inscrivez-vous à la/todos los derechos reservados
política de cookies/aceptar las cookies/aceptar todas las cookies/aceptar todo/política de privacidad/condiciones de uso/aviso legal/haga clic aquí/haz clic aquí
suscríbete a nuestro/suscríbete a nuestra/suscríbese a nuestro/suscríbese a nuestra/active javascript/activar javascript/regístrese en""".replace("\n", "/").split("/")


def phrase_words(text):
    """Words of the phrases in a text, from the left, none counted twice; of two that begin together the longer."""
    low, at, n = text.lower(), 0, 0
    while at < len(low):
        here = max((p for p in PHRASES if low.startswith(p, at)), key=len, default="")
        n += len(here.split())
        at += max(1, len(here))
    return n


def marks_by_hand(line):
    """Ends of the runs of punctuation marks."""
    word = lambda c: c.isalnum() or c == "_"
    ends, run = [], False
    for i, c in enumerate(line):
        nxt = line[i + 1:i + 2]
        is_mark = c in "!?;…)]" or (c == "," and not nxt.isdigit()) or (c in ".:\"'" and not (nxt and word(nxt)))
        if is_mark:
            ends[-1:] = [i + 1] if run else [*ends[-1:], i + 1]
        run = is_mark
    return ends


def removed_by_hand(line):
    """The line rules again, from their description, with plain loops."""
    words = line.split()
    n, chars = len(words), sum(not c.isspace() for c in line)
    symbols = sum(c in "#*$%&|<>" for c in line)
    if symbols >= 3 and symbols / chars > 1 / 20:
        return True
    letters = [c for c in line if c.upper() != c.lower()]
    if line.count("!!") > n / 3 or (n >= 5 and chars > 20 and letters and not any(c.islower() for c in letters)):
        return True
    bare = [re.sub(r"^[-.,:|>·•»/]+|[-.,:|>·•»/]+$", "", w).lower() for w in words]
    menu, small = sum(w in rules.NAV_WORDS for w in bare), sum(w in rules.NAV_JOINS for w in bare)
    if menu and menu >= small and menu + small + bare.count("") == n:
        return True
    between = [w for w in words if w in ("|", "/", "·", "•", "»", "›", ">", "→", "::")]
    entries = n - len(between)
    if any(w and w not in rules.NAV_WORDS | rules.NAV_JOINS for w in bare) and len(between) >= 3 and len(between) <= entries <= 2 * len(between) + 2 \
            and not line.rstrip().endswith((".", "!", "?")):
        return True
    found = phrase_words(line)
    if found:
        if found / n >= 1 / 12.5:
            return True
        noticed = 0
        for x in re.split(r"(?<=[.!?;])\s+", line):
            k = len(x.split())
            noticed += k if phrase_words(x) and phrase_words(x) / k >= 1 / 12.5 else 0
        if noticed >= n / 2:
            return True
    if n >= 10 and sum(a == b for a, b in zip(words, words[1:])) > n / 3:
        return True
    if n < 20:
        return False
    ends = marks_by_hand(line)
    return not ends or len(ends) < n // 40 or len(line[ends[-1]:].split()) >= 20 or max(words.count(w) for w in set(words)) > n / 3


def test_verdict_equals_brute_force():
    """Lines put together at random, in four languages: kept, lost characters and text against plain loops."""
    rng = random.Random(17)
    nav, small = sorted(rules.NAV_WORDS), sorted(rules.NAV_JOINS)
    plain = "river Mühle niño été water Boot bridge agua l'eau don't 3.14 1,000 SHOUT".split()
    gone = 0
    for _ in range(4000):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.randrange(6)
            pool = [nav + small, plain + nav, plain, PHRASES + plain, plain + PHRASES[:3], nav + ["|", "/", "·", "»"]][kind]
            words = [rng.choice(pool) for _ in range(rng.choice([1, 2, 4, 9, 15, 25, 45, 90]))]
            if rng.random() < 0.3:
                for i in range(0, len(words), rng.choice([1, 2, 3, 5])):
                    words[i] += " " + rng.choice("|/·•»›>→")
            if rng.random() < 0.7:
                for i in range(rng.randrange(12), len(words), rng.choice([3, 8, 15, 30])):
                    words[i] += rng.choice([".", ",", "!!", ";", "?", ":", " |"])
            line = " ".join(words)
            lines.append(line.upper() if rng.random() < 0.05 else line.capitalize() if rng.random() < 0.5 else line)
        text = CLEAN + "\n" + "\n".join(lines)
        seen, lost, left = set(), 0, []
        for line in text.split("\n"):
            if line in seen or removed_by_hand(line):
                lost += sum(not c.isspace() for c in line)
            else:
                left.append(line)
            seen.add(line)
        g = rules.judge(text)
        n, chars, _, _, _, base_failed = by_hand(text)
        assert (g.lost_chars, g.text) == (lost, "\n".join(left)), text
        assert g.kept == (not base_failed and lost / chars <= 0.4)
        gone += lost > 0
    assert 1000 < gone < 3999


def test_notice_parts_miss_nothing():
    """The quick look before the pattern: every phrase is still found, in any case."""
    for phrase in (*PHRASES, "S\u0130GN UP FOR", "CL\u0131CK HERE", "term\u017f of use", "\u212A".join(("coo", "ie policy"))):
        for text in (phrase, phrase.swapcase()) if phrase.isascii() else (phrase,):
            assert rules.BOILERPLATE.search(text) and rules.notice(text, 3), text
