import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import main_body, packing, repair, residue, site_lines, splitting, term_counts, tokens
from quillon.llm.visible import visible

PAGE = "page_id long, site_id int, content string"


def test_visible_keeps_lines():
    assert visible("<head>\n<title>x</title>\n</head>\n<p>a &amp; b</p><!-- c\nd -->\ne") == " \n\n\n a & b  \n\ne"


def test_repeated_lines(spark):
    rows = [(k, 1, f"Legal notice {k}\nbody text number {'abcdefghij'[k]}\n") for k in range(10)]
    rows += [(100 + k, 2, f"other {'abcdefghijklmnopqrstuvwxyz'[k]} page") for k in range(20)] + [(200, 1, None), (201, None, "Legal notice"), (None, 1, "Legal notice"), (202, 1, "")]
    df = spark.createDataFrame(rows, PAGE).withColumn("first", F.lit(1)).withColumn("key", F.lit("clash"))
    got = {tuple(r) for r in site_lines.repeated_lines(df).collect()}
    assert got == {(k, 0) for k in range(10)}
    clean = {r["page_id"]: r["content"] for r in site_lines.without_lines(df.filter("page_id < 10"), spark.createDataFrame(sorted(got), "page long, line_no int")).collect()}
    assert clean[3] == "body text number d\n"
    assert site_lines.repeated_lines(spark.createDataFrame([], PAGE)).collect() == []


def test_a_common_phrase_is_no_excess_but_a_shared_notice_is(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = iter(f"own {a}{b}{c}" for a in letters for b in letters for c in letters)
    rows = [(k, 0, f"{next(own)}\n{'Read more' if k < 4 else next(own)}\n{'Terms apply' if k < 30 else next(own)}") for k in range(60)]
    for s in range(1, 200):  # small sources: each says "Read more" on one page of ten, and every third has the notice on all pages
        rows += [(1000 + 10 * s + k, s, f"{next(own)}\n{'Read more' if not k else next(own)}\n{'Terms apply' if s % 3 == 0 else next(own)}") for k in range(10)]
    df = spark.createDataFrame(rows, PAGE)
    found = {(r["page"], r["line_no"]) for r in site_lines.repeated_lines(df).collect()}
    assert found == {(k, 2) for k in range(30)} | {(1000 + 10 * s + k, 2) for s in range(3, 200, 3) for k in range(10)}


def test_lines_left_out(spark):
    pages = spark.createDataFrame([(1, "a\nb\n\nc\n", "x"), (2, None, "x"), (3, "", "x"), (4, "only", "x"), (5, "as it is", "x"), (None, "a", "x")], "page_id long, content string, line_no string")
    drop = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (9, 0)], "page long, line_no int")
    assert {tuple(r) for r in site_lines.without_lines(pages, drop).collect()} == {(1, "a\n\nc\n"), (2, None), (3, ""), (4, ""), (5, "as it is")}


def test_term_counts_equal_dictionary(spark):
    r = random.Random(2)
    words = [" Abc", "abc", "ABC ", "ét", "ét", "", None, "  ", "żółw", "zz"] + [f"t{k}" for k in range(50)]
    rows = [(r.choice([1, 2, 3, None]), r.choice(words), r.choice([None, 0, -1, 1, 2, 7])) for _ in range(3000)] + [(1, "hot", 1)] * 1500
    want, sites = Counter(), {}
    for s, w, n in rows:
        t = unicodedata.normalize("NFC", w).lower().strip() if w else ""
        if t and n and n > 0:
            want[t] += n
            sites.setdefault(t, set()).update({s} - {None})
    df = spark.createDataFrame(rows, "site_id int, lemma string, frequency long").repartition(3)
    got = {x[0]: (x[1], x[2]) for x in term_counts.term_frequencies(df, "lemma", "site_id", "frequency", burst=4, hold=20).collect()}
    assert got == {t: (n, len(sites[t])) for t, n in want.items()}
    assert term_counts.term_frequencies(df.limit(0), "lemma", "site_id", "frequency").collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_many_lost_bytes(seed):
    """Five of sixteen bytes are lost, whole letters among them; the right word is the only one that fits."""
    m = repair.Model({w: 500 for w in "старый принтер хранит хлеб новая задача возле моста кастрюля сканер касса".split()})
    bad = list("кастрюля".encode().decode("latin-1"))
    for k in random.Random(seed).sample(range(16), 5):
        bad[k] = "\ufffd"
    assert m.restore("".join(bad)) == (True, "кастрюля")


def test_lattice_equals_all_readings():
    """The best path is the best of all ways to fill the lost bytes."""
    m = repair.Model({w: n for w, n in (("кот", 90), ("ком", 40), ("год", 60), ("рот", 50), ("гол", 20), ("café", 30))})
    for word in ("кот", "ком", "год", "рот", "гол", "café"):
        raw = word.encode()
        for k in range(len(raw)):
            if raw[k] < 0x80:
                continue
            row = [*raw[:k], repair.WILD, *raw[k + 1 :]]
            every = [w for b in range(0x80, 0x100) if (w := bytes([*raw[:k], b, *raw[k + 1 :]]).decode("utf-8", "ignore")) in m.counts]
            assert m.best_path(repair.utf8_arcs(row, m.alphabet)) == max(every, key=m.word)


def test_words_beyond_the_first_count(spark):
    """With room for few words in the model, the rest are known from the table of cells; garbled ones are not."""
    common = ["задача", "принтер", "кастрюля", "хлеб"]
    rare = [f"слов{a}{b}" for a in "аеиоуы" for b in "бвгдж"]
    text = " ".join(common * 50 + rare * 5 + ["Р·Р°РґР°С‡Р°"] * 4)
    m = repair.build_model(spark.createDataFrame([(text,), (None,)], "content string"), vocabulary=4)
    assert set(m.counts) == set(common) and all(m.count(w) == 5 for w in rare) and not m.count("нет") and not m.count("Р·Р°РґР°С‡Р°")
    assert m.restore("словаб".encode().decode("cp1251")) == (True, "словаб")


def _model():
    words = "старый принтер хранит хлеб новая задача возле моста кастрюля".split() + ["café", "Größe", "—", "“", "”", "«", "»"]
    return repair.Model({w: 500 for w in words} | {w.capitalize(): 50 for w in words})


@pytest.mark.parametrize("true, wrong", [("utf-8", "cp1251"), ("utf-8", "cp1252"), ("utf-8", "koi8-r"), ("utf-8", "cp866"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251")])
def test_channels_round_trip(true, wrong):
    text = "Старый принтер хранит хлеб, новая задача возле моста"
    table = {v: k for k, v in repair._byte_of(wrong).items()}
    bad = "".join(chr(b) if b < 128 else table[b] for b in text.encode(true))
    assert _model().restore(bad) == (True, text)


def test_clean_text_stays():
    m = _model()
    for t in ("Старый принтер хранит хлеб", "СТАРЫЙ ПРИНТЕР", "Größe café", "naïve façade, 20 °C ± 3", "", None, "plain"):
        assert m.restore(t) == (False, t)
    assert m.restore("lost ��")[0]


def test_wildcards_are_filled():
    assert repair.Model({"jalapeño": 9}).fill("jalape�o") == "jalapeño"


@pytest.mark.parametrize("text", ["сканер", "касса", "Новая", "старая касса", "Новая касса — сканер"])
def test_lost_bytes_inside_letters_are_filled(text):
    m = repair.Model({w: 500 for w in ("сканер", "касса", "Новая", "старая", "—")})
    assert m.restore(text.encode("utf-8").decode("cp1252", "replace")) == (True, text)


@pytest.mark.parametrize("content, found", [
    ("<p>Menu</p>\n<h1>404 — page not found</h1>\n<footer>© X · Terms</footer>", True), ("Меню\nДоступ к /a/b-1 запрещён", True), ("<p>Hello {{ user_name }}, the old printer stands there</p>", True),
    ("<p>The template variable <code>{{ price }}</code> is replaced by a number</p>", False), ("The chapter explains why a server answers 404 and how to write a polite page-not-found text. " * 2, False),
    ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed", True), ("price NaN ₽ today", True), ("", False), (None, False), ("An ordinary text about a bridge and a river", False),
])
def test_residue(content, found):
    share, inside = residue.residue_share(content)
    assert (share >= 0.03 or inside) == found


# messages of usual servers and frameworks, none of them taken from the tables; the phrases were composed without them
HELD_OUT = (
    "HTTP Error 503. The service is unavailable.", "For full functionality of this site it is necessary to enable JavaScript.", "This site doesn't work properly without JavaScript enabled", "Необходимо включить JavaScript", "Página no encontrada", "The requested URL was not found on this server.",
    "You don't have permission to access this resource.", "Oops! That page can’t be found.", "404 Not Found: The resource requested could not be found on this server!", "Error establishing a database connection", "Sorry, the page you are looking for could not be found.", "Whoops, looks like something went wrong.",
    "Запрошенная страница не найдена", "Сайт временно недоступен. Ведутся технические работы.", "Die angeforderte Seite wurde nicht gefunden", "Cette page n’existe plus", "La pagina richiesta non esiste", "A página que você procura não foi encontrada", "Strona nie została znaleziona", "Pagina niet gevonden", "Сторінку не знайдено",
    "Please turn JavaScript on and reload the page.", "503 Service Temporarily Unavailable", "502 Bad Gateway", "Access Denied. You are not authorized to view this page.", "Sayfa bulunamadı", "Acceso denegado", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Coming soon", "Your session has expired. Please log in again.",
)


def test_held_out_messages():
    lines = ["The old bridge over the river was repaired in spring and carries trams again."] * 4
    missed = [m for m in HELD_OUT if residue.residue_share("\n".join([*lines, m]))[0] < 0.03]
    assert len(missed) <= 0.2 * len(HELD_OUT), missed
    alone = [m for m in HELD_OUT if residue.residue_share(m)[0] < 0.5]
    assert len(alone) <= 0.2 * len(HELD_OUT), alone


def test_one_long_line_and_chrome():
    message = "Error 503. The service is unavailable. Please try again later. " * 8
    assert residue.residue_share(message)[0] == 1.0 and residue.residue_share(message.replace(". ", ".\n"))[0] >= 0.8
    text = "The old bridge over the river was repaired. " * 40 + "Page not found. " + "Trams cross it again every day. " * 40
    assert 0 < residue.residue_share(text)[0] < 0.01
    assert residue.residue_share("<p>A long text about a bridge and a river</p><noscript>Please enable JavaScript</noscript>")[0] == 0
    assert residue.residue_share("<noscript>Please enable JavaScript</noscript>")[0] == 1

def test_min_cut_equals_brute_force():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 7)
        costs = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(r.randrange(n), r.randrange(n), r.uniform(0, 3)) for _ in range(n + 2)]

        def cost(labels, costs=costs, edges=edges):
            return sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(costs, labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(2**n))
        assert cost(main_body.min_cut(costs, edges)) == pytest.approx(best)


def test_main_body(spark):
    page = '<html><head><title>The {0} — Brand</title></head><body>\n<nav><a href="/">Home</a></nav>\n<h1>The {0}</h1>\n<p>A {0} warms the old printer near the bridge, and the {0} stays.</p>\n<footer>© 2020 Brand</footer></body></html>'
    rows = [(k, 1, page.format(w)) for k, w in enumerate(["river", "garden", "lamp", "stove"] * 5)] + [(90, 1, None), (91, 1, ""), (92, None, page.format("boat"))]
    pages = spark.createDataFrame(rows, PAGE)
    sites = spark.createDataFrame([(1, "Brand Online")], "site_id int, name string")
    got = {tuple(r) for r in main_body.main_body(pages, sites, repair.Model({})).collect()}
    assert got == {(k, n) for k in [*range(20), 92] for n in (2, 3)}


@pytest.fixture(scope="module")
def encoder():
    pytest.importorskip("public_tokenizers")
    return tokens.Encoder(tokens.default_path())


def test_ids_equal_the_library(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    texts = ["", "hello  world", " a\n\n b\t", "Привет, мир! 12345", "<|endoftext|>", "x" * 700, "ab" * 400, "日本語 😀\u0000", "don't    stop ", "   "]
    assert [list(x) for x in encoder.encode([None, *texts])] == [[], *(t.encode(x, add_special_tokens=False).ids for x in texts)]


def test_memory_of_words_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 5_000)
    e = tokens.Encoder(tokens.default_path())
    for k in range(30):
        text = f"word{k} one two three {'x' * k} слово{k} " * 3
        assert list(e.encode([text])[0]) == list(encoder.encode([text])[0])
        assert e.held < 5_000 + 15_000


def test_a_term_in_all_records_is_split(spark):
    rows = [(k, "hot", 1) for k in range(5000)] + [(k % 7, f"t{k % 50}", 1) for k in range(500)] + [(None, "hot", 3)]
    df = spark.createDataFrame(rows, "site_id int, lemma string, frequency long").repartition(4)
    got = {x[0]: (x[1], x[2]) for x in term_counts.term_frequencies(df, "lemma", "site_id", "frequency").collect()}
    assert got["hot"] == (5003, 5000) and len(got) == 51 and got["t3"] == (10, 7)


def test_packing(spark):
    r = random.Random(1)
    rows = [(k, r.choice([0, 1, 7, 30, 30, 30, 64, 99, 250])) for k in range(400)]
    got = [tuple(x) for x in packing.pack(spark.createDataFrame(rows, "key long, tokens long"), 100).collect()]
    load, per = Counter(), Counter()
    for k, _, _, size, box in got:
        load[box] += size
        per[k] += size
    assert dict(per) == dict(rows) and max(load.values()) <= 100
    assert len(load) <= 1.03 * sum(n for _, n in rows) / 100 + 1
    assert packing.pack(spark.createDataFrame([], "key long, tokens long"), 100).collect() == []


def test_configurations_carry_the_plan():
    r, hist, capacity = random.Random(3), Counter(), 512
    for _ in range(150):
        a = r.randint(130, 200)
        b = r.randint(130, min(250, capacity - a - 129))
        hist.update((a, b, capacity - a - b))  # only right triplets fill a container
    solution = packing.fractional_solution(hist, capacity)
    for s, n in hist.items():
        assert sum(x * c.get(s, 0) for c, x in solution) >= n * (1 - 1e-9)
    plan, left = packing.program_plan(hist, capacity)
    assert sum(n * sum(c.values()) for c, n in plan) > 0.9 * sum(hist.values())
    full, used = packing.make_plan(hist, capacity), Counter()
    for c, n in full:
        assert sum(s * k for s, k in c.items()) <= capacity
        used.update({s: k * n for s, k in c.items()})
    assert used == hist
    assert sum(n for _, n in full) < sum(n for _, n in packing.largest_first(hist, capacity))


def test_splitting(spark, encoder):
    r = random.Random(4)
    text = " ".join(" ".join(r.choices(["river", "bridge", "lamp", "печка", "сад"], k=9)) + ". " for _ in range(120))
    rows = [(1, text), (2, "z9" * 900), (3, "short"), (4, None), (5, ""), (6, "слово" * 400)]
    got = sorted(tuple(x) for x in splitting.split_oversized(spark.createDataFrame(rows, "key long, text string"), "key", "text", 256, 24).collect())
    assert {x[0] for x in got} == {1, 2, 6}
    for a, b in zip(got, got[1:]):
        if a[0] == b[0]:
            assert b[2] <= a[3] < b[3]
    for k, _, a, b, n, t in got:
        assert t == dict(rows)[k][a:b] and n == encoder.sizes([t])[0] <= 256
    for k in (1, 2, 6):
        own = [x for x in got if x[0] == k]
        assert own[0][2] == 0 and own[-1][3] == len(dict(rows)[k])
