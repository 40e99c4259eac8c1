"""HTML, languages, secrets, byte-level BPE and decontamination."""

import base64
import bz2
import functools
import gzip
import html as entities
import random
import re
import time
import zlib

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F

from graupel.llm import bpe, decontam, html, langid, secrets

ODD = "id long, text string, lang string, k0 string, page string, cid long, key string"


def odd(spark, texts):
    """Rows with clashing extra columns; the last one is repeated."""
    rows = [(i, t, "en", "x", "<p>", 7, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:], ODD)


def documents(sf):
    return duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet' order by doc_id").fetchall()


# ---- HTML ----


def test_html_equals_the_article(spark, sf):
    got = {r["page_id"]: r for r in html.op1_html_text(spark, sf).collect()}
    for page_id, page in duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall():
        inner = page[page.index("<article>") : page.index("</article>")]
        want = " ".join(entities.unescape(re.sub(r"<[^>]+>", lambda m: "" if re.match(r"</?b>", m[0]) else " ", inner)).split())
        assert got[page_id]["text"] == want and got[page_id]["n_chars"] == len(want)


PAGE = """<html><body><header><a href=/>Home</a> <a href=/x>X</a></header><nav><ul><li><a>menu</a></ul></nav>
<div id=wrap><div class="sidebar">%s</div><div class="content"><h2>Title here</h2><p>First &amp; <b>bo</b>ld text of the article, long enough.
<p>Second paragraph,&nbsp;also   long enough to count as text.<table><tr><td>cell one<td>cell two</table><div class="comments"><p>nice post indeed, thank you very much for this</div></div></div>
<form><p>Your mail <input></form><script>if (a < b) { document.write("<p>no</p>") }</script><div class="cookie-notice">We use cookies on this site to make it better for you.</div><footer>&copy; 2024</footer></body></html>"""


def test_html_without_an_article_element():
    text = html.main_text(PAGE % "<p>Side words that are not part of it.</p>")
    assert text == "Title here First & bold text of the article, long enough. Second paragraph, also long enough to count as text. cell one cell two"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "<div><div><div>", "</p></b>", "<p>" * 3000 + "x", "<div>" * 5000 + "deep text" + "</div>" * 5000, "plain text"])
def test_html_never_fails(page):
    assert isinstance(html.main_text(page), str)


def test_html_empty_table_and_clashes(spark):
    df = odd(spark, [None, "", "<p>a</p>"])
    assert html.extract(df.where("false"), "text", ("id", "page")).count() == 0
    got = html.extract(df, "text", ("id", "page")).orderBy("id").collect()
    assert [r["text"] for r in got] == ["", "", "a", "a"] and got[0]["page"] == "<p>"


# ---- languages ----


def test_language_accuracy_on_texts_not_learned_from(spark, sf):
    got = {r["doc_id"]: r for r in langid.op2_language_id(spark, sf).collect()}
    held = [(d, lang) for d, _, lang in documents(sf) if zlib.crc32(str(d).encode()) % 3 == 1]
    assert len(held) > 40 and all(got[d]["held_out"] for d, _ in held)
    assert sum(got[d]["lang_pred"] == lang for d, lang in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["accepted"] for r in got.values())


def test_distributions_sum_to_one(spark, sf):
    import numpy as np

    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"), per_lang=30, order=3)
    for context in (0, 5, (7 << 6) | 3):
        codes = (np.int64(context) << 6) | np.arange(model.n_symbols)
        assert np.allclose(np.exp(model.log_prob(codes, 3).astype(float)).sum(0), 1, atol=1e-4)


def test_languages_of_odd_texts(spark):
    texts = [None, "", "12 !?", "the cat and the dog", "le chat et le chien", "the dog", "日本語", "x" * 50000]
    rows = [(i, t, "fr" if t and t.startswith("le") else None if i == 7 else "en") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = langid.identify(df, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and got[0]["score"] == 0 and not got[0]["accepted"]
    assert got[3]["lang_pred"] == "en" and got[4]["lang_pred"] == "fr" and got[6]["lang_pred"] in ("en", "fr")
    empty = langid.train(df.where("false"))
    assert {r["lang_pred"] for r in langid.identify(df, empty).collect()} == {"und"}
    assert langid.identify(df.where("false"), model).count() == 0


# ---- secrets ----


def brute_spans(text):
    kinds = (r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    found = []
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text, re.I | re.A if k == 0 else 0):
            if len(m[1] if k == 0 else m[0]) >= (6, 20, 24)[k]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_equal_brute_force(spark, sf):
    docs = documents(sf.replace("sf0.001", "sf0.01"))
    assert sum(len(brute_spans(t)) for _, t, _ in docs) > 0
    for _, text, _ in docs:
        assert secrets.base_spans(text) == brute_spans(text)
    rng = random.Random(5)
    parts = ["AKIA", "A1B2C3D4E5F6G7H8", "token", "Api_Key", "PASSWORD", " = ", ":", '"', "abcdef0123456789", "deadbeef" * 3, "ſecret", "toKen", "é", "\n", "zz"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert secrets.base_spans(text) == brute_spans(text), text


SECRET = "password=hunter22secret"


@pytest.mark.parametrize(
    "token",
    [
        base64.b64encode(SECRET.encode()).decode(), base64.b64encode(gzip.compress(SECRET.encode())).decode(), base64.b64encode(base64.b64encode(SECRET.encode())).decode(),
        "".join(f"%{b:02x}" for b in SECRET.encode()), "".join(f"\\u{ord(c):04x}" for c in SECRET), "".join(f"%{b:02X}" for b in base64.b64encode(zlib.compress(SECRET.encode()))),
    ],
)
def test_layers_map_to_the_outer_token(token):
    text = f"some words before {token} and after"
    assert secrets.base_spans(text) == []
    spans, layers = secrets.layer_spans(text, [])
    assert layers >= 1 and (text.index(token), 0, text.index(token) + len(token)) in spans


def test_worklist_ends():
    for text in ("%25" * 2000, "%2525252525", "A" * 5000, base64.b64encode(b"%41" * 999).decode()):
        secrets.layer_spans(text, secrets.base_spans(text))


def test_repeated_tokens_are_found_at_every_place(spark):
    token = base64.b64encode(SECRET.encode()).decode()
    outer = base64.b64encode(f"{token} and {token}".encode()).decode()
    url = "".join(f"%{b:02x}" for b in SECRET.encode())
    text = f"one {token} two {token} three {outer} four {url} five {url} six {outer} seven {token}"
    spans, layers = secrets.layer_spans(text, secrets.base_spans(text))
    want = {(m.start(), 0, m.end()) for t in (token, outer, url) for m in re.finditer(re.escape(t), text)}
    assert spans == want and len(want) == 7
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert secrets.redact(df).first()["text"] == re.sub("|".join(map(re.escape, (token, outer, url))), "[REDACTED]", text)


def deep(raw, n):
    for _ in range(n):
        raw = gzip.compress(raw)
    return raw


@pytest.mark.parametrize(
    "raw",
    [
        deep(SECRET.encode(), 12), gzip.compress(b"nothing") + gzip.compress(SECRET.encode()), gzip.compress(b"nothing") + SECRET.encode(), bz2.compress(b"nothing") + bz2.compress(SECRET.encode()),
        deep(b"some words,\n" * 1_500_000 + SECRET.encode(), 2), gzip.compress(b"pass" + b"word=hun,\n" * 2_000_000 + base64.b64encode(SECRET.encode()) + b"\n"),
    ],
    ids=["deep", "members", "tail", "bz2", "large", "large with a layer"],
)
def test_layers_are_opened_to_the_end(raw):
    token = base64.b64encode(raw).decode()
    text = f"words {token} words"
    assert secrets.layer_spans(text, secrets.base_spans(text))[0] == {(6, 0, 6 + len(token))} | set(secrets.base_spans(text))


def test_repeats_inside_repeats_do_not_multiply():
    text = SECRET
    for _ in range(40):
        text = 2 * (base64.b64encode(gzip.compress(text.encode())).decode() + " ")
    spans, layers = secrets.layer_spans(text, [])
    assert len(spans) == 2 and layers == 40


def test_secret_rows_and_redaction(spark):
    df = odd(spark, [None, "", "token = 'abcdef12' x", "y " * 30000])
    got = secrets.scan(df, "id").orderBy("id").collect()
    assert [(r["n_assign"], r["spans"]) for r in got] == [(0, ""), (0, ""), (1, "assign:0:17"), (0, ""), (0, "")]
    clean = {r["id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[0] is None and clean[1] == "" and clean[2] == "[REDACTED]' x" and len(clean[3]) == 60000
    assert secrets.scan(df.where("false"), "id").count() == 0


# ---- byte-level BPE ----


def test_bpe_equals_the_library_and_decodes(spark, sf):
    ranks, pattern = bpe.public_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [t for _, t, _ in documents(sf)[:60]] + ["", "a" * 3000, "日本語 текст 🙂", "I'll we've   \n\n x  ", "<|endoftext|>", "\x1c\x85²½"]
    df = spark.createDataFrame([*enumerate(texts), (998, None)], "doc_id int, text string")
    back = bpe.decode(bpe.encode(df, ranks, pattern), ranks).collect()
    for r in back:
        text = texts[r["doc_id"]] if r["doc_id"] < 900 else ""
        assert r["ids"] == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert bpe.digests(df.where("false"), ranks, pattern).count() == 0
    both = bpe.digests(df, ranks, pattern, with_ids=True).collect()
    assert {r["doc_id"]: len(r["ids"]) for r in both} == {r["doc_id"]: r["n_tokens"] for r in both}


def test_words_split_alike_on_both_paths():
    import regex

    ranks, pattern = bpe.public_ranks()
    split, general = bpe.splitter(pattern), regex.compile(pattern).findall
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("abcdé ßÀ×÷'sll \n\t\r  .,!%$0189²½日\x1c\x85ſ") for _ in range(rng.randint(0, 20)))
        assert split(text) == general(text)


# ---- decontamination ----


def plain(text):
    return " ".join(re.sub(r"[\W_]+", " ", text.lower()).split())


def test_whole_items_are_found_and_clean_texts_are_not(spark, sf):
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op3_decontamination(spark, sf).collect()}
    want = {(d, i) for d, t, _ in documents(sf) for i, b in items if f" {plain(b)} " in f" {plain(t)} "}
    assert want and want <= got
    near = {d for d, _ in got} - {d for d, _ in want}
    assert not near


def test_edited_items_are_found(sf):
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    index, rng = decontam.index(items), random.Random(4)
    for k, (item, text) in enumerate(items):
        chars = list(text)
        for _ in range(len(chars) // 25):
            chars[rng.randrange(len(chars))] = rng.choice("abcxyz")
        found = decontam.matches("Some words before. " + "".join(chars).upper() + " Some words after.", index)
        assert item in {f[0] for f in found}


def test_every_passage_of_79_characters_is_found(sf):
    items = [(i, plain(t)) for i, t in duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()]
    index, tried = decontam.index(items), 0
    for item, text in items[:20]:
        for at in range(0, len(text) - 79, 5):
            found = decontam.matches("qq " + text[at : at + 79] + " zz", index)
            assert text[at] == " " or text[at + 78] == " " or item in {f[0] for f in found}
            tried += 1
    assert tried > 50


def brute_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_alignment_equals_the_full_table():
    import numpy as np

    rng = random.Random(9)
    for _ in range(200):
        a = [rng.randint(0, 3) for _ in range(rng.randint(5, 30))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 5))] + [x if rng.random() > 0.1 else rng.randint(0, 3) for x in a] + [rng.randint(0, 3) for _ in range(rng.randint(0, 5))]
        want, got = brute_distance(a, b), decontam.aligned(np.array(a), np.array(b), 6)
        assert (got[0] if got else None) == (want if want <= 6 else None)


def test_contamination_of_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from the hunters in the dark wood"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "ab"), (1, item)], "item_id int, text string")
    docs = odd(spark, [None, "", item.replace(" ", ", "), "x" * 100000 + " " + item])
    got = decontam.contaminated(docs, items, "id").collect()
    assert sorted((r["id"], r["item_id"]) for r in got) == [(2, 1), (3, 1), (3, 1)]
    assert sorted(r["id"] for r in decontam.clean(docs, items).collect()) == [0, 1]
    assert decontam.contaminated(docs, items.where("false"), "id").count() == 0
    assert decontam.contaminated(docs.where("false"), items, "id").count() == 0


def test_html_title_beside_the_body_and_layout_classes():
    page = '<body><div class="page with-sidebar"><div class="post"><h1>A title</h1><div class="text"><p>%s<p>%s</div></div><div class="sidebar"><p>Side.</div></div></body>'
    one, two = "Long text of the first paragraph, with many words in it.", "Long text of the second paragraph, with as many words."
    assert html.main_text(page % (one, two)) == f"A title {one} {two}"


# ---- repetitive texts, several blocks, edits against brute force ----


@pytest.mark.parametrize("item, text", [("ha " * 40, "he said " + "ha " * 25), ("no " * 50, "no " * 30), ("0" * 100, "0" * 60), ("na " * 50, "na " * 400), ("ab" * 1000, "ab" * 500_000)])
def test_repetitive_texts_end_in_bounded_memory(item, text):
    import tracemalloc

    index = decontam.index([(1, item)])
    tracemalloc.start()
    found = decontam.matches(text, index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and found[0][0] == 1 and peak < 400e6


def nearest_part(segment, codes):
    """Least edits between the segment and any part of the codes (Sellers)."""
    row = [0] * (len(codes) + 1)
    for i, x in enumerate(segment, 1):
        new = [i]
        for j, y in enumerate(codes, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited_table(rng, words=60):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, said(rng.randint(3, 30))) for i in range(8)]
    docs = []
    for k in range(30):
        _, text = rng.choice(items)
        at = rng.randint(0, max(0, len(text) - 70))
        chars = list(text[at : at + 90])
        for _ in range(rng.randint(0, 9)):
            j = rng.randrange(len(chars))
            chars[j] = rng.choice(["", "x", chars[j] + "y"])
        docs.append((k, said(rng.randint(0, 8)) + " " + "".join(chars) + " " + said(rng.randint(0, 8))))
    return items, docs


def test_edit_matches_equal_brute_force():
    rng, tried = random.Random(12), 0
    for _ in range(4):
        items, docs = edited_table(rng)
        index = decontam.index(items)
        for _, text in docs:
            codes = decontam.normal(text)[0].tolist()
            want = {items[o][0] for seg, owners, e in zip(index.segments, index.owners, index.edits.tolist()) if nearest_part(seg.tolist(), codes) <= e for o in owners}
            assert {f[0] for f in decontam.matches(text, index)} == want
            tried += len(want)
    assert tried > 60


def test_blocks_give_what_one_index_gives(spark):
    items, docs = edited_table(random.Random(5))
    i, d = spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame([*docs, (98, None), (99, "")], "doc_id int, text string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    one, many = decontam.contaminated(d, i), decontam.contaminated(d, i, block_chars=200)
    assert rows(one) == rows(many) and one.count() > 5
    kept = decontam.clean(d, i)
    assert rows(kept) == rows(decontam.clean(d, i, block_chars=200)) == sorted((k, t) for k, t in [*docs, (98, None), (99, "")] if k not in {r["doc_id"] for r in one.collect()})


# ---- payloads on every path ----

SECRET = "password = hunter2hunter2"


def packings(rng):
    b64 = lambda b: base64.b64encode(b)
    wrapped = lambda b: b"\n".join(b64(b)[i : i + 76] for i in range(0, len(b64(b)), 76))
    url = lambda b: "".join(chr(x) if chr(x).isalnum() and x < 128 else f"%{x:02x}" for x in b).encode()
    escaped = lambda b: "".join(chr(x) if 32 < x < 127 and chr(x) not in "\\'\"" else f"\\x{x:02x}" for x in b).encode()
    noise = bytes(rng.randrange(256) for _ in range(300))
    return {
        "gzip in wrapped base64": wrapped(gzip.compress(noise + SECRET.encode() + b"\n" + noise)), "gzip in a URL": url(gzip.compress(SECRET.encode())), "zlib in escapes": escaped(zlib.compress(SECRET.encode())),
        "gzip in escapes": escaped(gzip.compress(SECRET.encode(), mtime=0)), "bz2 in a URL": url(bz2.compress(SECRET.encode())), "binary around it": b64(b"\xff\xfe\x00 " + SECRET.encode() + b" \x80\x81"),
        "latin-1": b64("é ü ".encode("latin-1") + SECRET.encode()), "zlib nine times": b64(functools.reduce(lambda b, _: zlib.compress(b), range(9), SECRET.encode())),
    }


@pytest.mark.parametrize("name", sorted(packings(random.Random(1))))
def test_payloads_are_opened_on_every_path(name):
    inside = packings(random.Random(1))[name].decode("latin-1")
    text = f"see\n{inside}\nand again\n{inside}\nend"
    spans = secrets.layer_spans(text, secrets.base_spans(text))[0]
    for at in (text.index(inside), text.rindex(inside)):
        assert any(k == 0 and a <= at + 1 and b >= at + len(inside) - 1 for a, k, b in spans), (spans, at, len(inside))


def test_random_nestings_are_found_at_each_place(spark):
    rng = random.Random(8)
    layers = [
        lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="), lambda s: "".join(f"%{b:02X}" for b in s.encode()),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode(), lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
        lambda s: base64.b64encode(bz2.compress(s.encode())).decode(),
    ]
    texts, places = [], []
    for k in range(60):
        token = f"api_key = K{rng.randrange(10**9):09d}z"
        inner = token
        for _ in range(rng.randint(1, 4)):
            inner = rng.choice(layers)(f" {inner} " if rng.random() < 0.5 else inner)
        text, at = "", []
        for _ in range(rng.randint(1, 3)):
            text += "some words " * rng.randint(0, 3)
            at.append((len(text), len(text) + len(inner)))
            text += inner + " "
        texts.append(text), places.append((at, token))
    for text, (at, _) in zip(texts, places):
        spans = secrets.layer_spans(text, secrets.base_spans(text))[0]
        assert all(any(a < end and b > start for a, _, b in spans) for start, end in at), text
    redacted = secrets.redact(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in redacted:
        assert not secrets.layer_spans(r["text"], secrets.base_spans(r["text"]))[0]


# ---- HTML: by density alone, attribute values, forms, broken tags ----


def test_html_without_article_tags_and_class_names(sf):
    pages = [p for (p,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    same = 0
    for page in pages:
        bare = re.sub(r'\s(class|id)="[^"]*"', "", page.replace("<article>", "<div>").replace("</article>", "</div>"))
        same += html.main_text(page) == html.main_text(bare)
    assert same >= 0.95 * len(pages)


WORDS = "Words of a paragraph that is long enough to be read. "


@pytest.mark.parametrize("tag", ['style="overflow:hidden "', 'title="hidden gems"', 'data-id="comment"', 'class="side-effects"', "data-x='id=comment'", 'class="with-sidebar"'])
def test_html_values_are_not_names(tag):
    assert html.main_text(f"<body><div><p>{WORDS * 3}</p><div {tag}><p>{WORDS}</p></div></div></body>").split() == (WORDS * 4).split()


@pytest.mark.parametrize("tag", ["hidden", 'class="cookie-notice"', 'id="comments"', "class=sidebar", 'role="navigation"', 'aria-hidden="true"', 'class="related posts"'])
def test_html_noise_by_attribute(tag):
    assert html.main_text(f"<body><div><p>{WORDS * 3}</p><div {tag}><p>{WORDS}</p></div></div></body>").split() == (WORDS * 3).split()


def test_html_page_within_one_form():
    page = f"<body><form id=aspnetForm><div class=content><h1>Title</h1><p>{WORDS * 3}</p><form class=x><label>Mail</label><input></form></div></form></body>"
    assert html.main_text(page).split() == ("Title " + WORDS * 3).split()


@pytest.mark.parametrize("page", ['<a "' * 250_000, ('<a "' * 7 + ">") * 30_000, "<div><p>text <b" * 60_000, "<a '\"" * 200_000, "<" * 1_000_000, "<!--" * 250_000, "<a b='" * 100_000 + ">"])
def test_html_broken_tags_cost_what_their_length_is(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 10


# ---- secrets: shifted frames, bare deflate, wide text, short lines, seams, many escapes ----


def bare(raw):
    d = zlib.compressobj(9, zlib.DEFLATED, -15)
    return d.compress(raw) + d.flush()


@pytest.mark.parametrize("prefix", ["x", "id", "ab/", "key/", "path/", "id_tok", "a-b-c-d", "example/t", "https://h.example/t/"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress, bare, base64.b64encode, lambda b: b.decode().encode("utf-16"), lambda b: b.decode().encode("utf-32-be")], ids=["plain", "gzip", "zlib", "bz2", "bare", "twice", "utf-16", "utf-32"])
def test_base64_behind_letters_of_its_alphabet(prefix, pack):
    for secret in (b"password=hunter2hunter2", b"note: token=abcdef"):
        token = prefix + base64.b64encode(pack(secret)).decode()
        text = f"words {token} words"
        spans = secrets.layer_spans(text, secrets.base_spans(text))[0]
        assert any(k == 0 and a <= 6 + len(prefix) and b == 6 + len(token) for a, k, b in spans), (token, spans)


@pytest.mark.parametrize("width", [4, 8, 20, 59, 64])
def test_base64_in_short_lines(width):
    token = base64.b64encode(bare(b"some words in front of it, password=hunter2hunter2")).decode()
    lines = "\n".join(token[i : i + width] for i in range(0, len(token), width))
    text = f"see: {lines}\n\nend"
    spans = secrets.layer_spans(text, secrets.base_spans(text))[0]
    assert any(k == 0 and a <= 5 and b >= 5 + len(lines) for a, k, b in spans)


def test_wrapped_base64_over_a_seam_of_a_large_layer(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_LAYER", 1 << 14)
    monkeypatch.setattr(secrets, "CHUNK", 1 << 12)
    token = base64.b64encode(b"a long enough text in front of the secret, password=hunter2hunter2, and some more").decode()
    block = "\n".join(token[i : i + 24] for i in range(0, len(token), 24))
    for at in range((1 << 14) - 160, (1 << 14) + 20, 9):
        layer = ("plain words, and more.\n" * 2000)[:at] + "\n\n" + block + "\n\n" + "plain words, and more.\n" * 500
        outer = base64.b64encode(gzip.compress(layer.encode())).decode()
        assert secrets.layer_spans(outer, [])[0] == {(0, 0, len(outer))}, at


def test_many_escapes_and_secrets_map_in_linear_time():
    line = r"AB words and password=hunter2hunter2 " + r"C D E " * 3
    text = line * 10_000
    began = time.time()
    spans = secrets.layer_spans(text, secrets.base_spans(text))[0]
    assert len(spans) == 10_000 and time.time() - began < 10
    assert all(text[a:b] == "password=hunter2hunter2" for a, _, b in spans)


def test_long_runs_without_a_layer_cost_what_their_length_is():
    rng = random.Random(4)
    began = time.time()
    for text in ("a" * 300_000, "word\n" * 60_000, base64.b64encode(rng.randbytes(200_000)).decode()):
        assert secrets.layer_spans(text, [])[0] == set()
    assert time.time() - began < 15
