"""The text operators against brute force, and on nulls, empty tables, repeated rows and clashing names."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import _common as c
from gridloom.llm import chat, decontaminate, html_extract, jaccard_join, language_id, packing, quality_rules, resharding, substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\x0c\r"


def corpus(n=160, seed=1):
    """Texts of a small vocabulary with copies, near copies, shared passages, nulls, empties, one long text and other spaces."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [r.choice(words) for _ in range(40)]
    rows = []
    for i in range(n):
        kind = i % 8
        own = [r.choice(words) for _ in range(r.choice([3, 20, 60, 120]))]
        if kind == 1 and rows:
            own = (rows[r.randrange(len(rows))][1] or "").split()
        elif kind == 2 and i > 20:
            own = (rows[(i - 9) // 8 * 8][1] or "").split()
            if own:
                own[r.randrange(len(own))] = "changed"
        elif kind == 3:
            own[5:5] = passage[: r.randrange(10, 40)]
        text = None if i == 7 else "" if i == 15 else " \n\t " if i == 23 else "".join(w + r.choice(SPACES) for w in own)
        rows.append((i, text))
    rows.append((n, " ".join(r.choice(words) for _ in range(20_000))))
    rows.append((n + 1, "\u00a0nbsp\u00a0is no\u2003space \x1c here ü é 漢字 " * 4))
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def split(text):
    return (text or "").encode().split()


# 1. substring dedup


def removed(rows, window=13):
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def test_substring_dedup_brute_force(spark):
    rows = corpus()
    rows += [rows[3], (5, "same id " + " ".join(f"w{k}" for k in range(30))), (None, rows[160][1]), (None, None)]
    got = substring_dedup.substring_dedup(frame(spark, rows))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str) == removed(rows)


def test_substring_dedup_spans_cover_what_is_removed(spark):
    rows = corpus()
    for r in substring_dedup.substring_dedup(frame(spark, rows), keep_columns=True).collect():
        covered = set()
        for s in r.spans:
            assert s.length >= 13 or covered
            covered.update(range(s.start, s.start + s.length))
        assert len(covered) == r.n_removed


def test_substring_dedup_removes_by_factors(monkeypatch):
    import pyarrow as pa

    factors, made = substring_dedup._factors, []
    monkeypatch.setattr(substring_dedup, "_factors", lambda *a: made.extend(factors(*a)) or factors(*a))
    rows = sorted((x for x in corpus() if x[0] is not None), key=lambda x: x[0])
    docs = pa.table({"__gl_id": [i for i, _ in rows], "__gl_text": [t for _, t in rows], "__gl_rest": [None] * len(rows), "__gl_block": [0] * len(rows)})
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("block", pa.int32()), ("offset", pa.int64())]))
    schema = substring_dedup.c.arrow_schema(n_words=pa.int64(), n_removed=pa.int64(), kept_text=pa.string(), spans=span)
    got = substring_dedup._parse(13, schema, False)(docs, substring_dedup._ANSWER.empty_table())
    assert made and 0 < sum(got.column("n_removed").to_pylist()) <= sum(k for _, k, _, _ in made)
    assert not any(got.column("spans").to_pylist())


def test_substring_dedup_empty_and_clashing(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0
    df = frame(spark, [(1, "a b", 5, "x")], "doc_id long, text string, n_words int, block string")
    r = substring_dedup.substring_dedup(df, keep_columns=True).first()
    assert (r.n_words, r.rest.n_words, r.rest.block, r.text) == (2, 5, "x", "a b")


# 2. html


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script><style>p{{}}</style></head><body><header>Top</header><nav><ul><li>menu</li></ul></nav>
<div class="cookie-notice">cookies</div><article><h1>T &amp; x</h1><p><b>One <i>two</i>
 three<br>four<p>{0}<aside>side</aside><ul><li>a<li>b</ul><form><p>f</form><div class="ad">buy</div>tail <!-- z --> end
<section id="comments"><p>c1</p></section></article><div id="sidebar">s</div><footer>&copy; f</footer></body></html>"""


def test_html_blocks():
    assert html_extract.slots(PAGE.format("Five")) == ["T & x", "One two three four", "Five", "a", "b", "tail end"]
    assert html_extract.slots("plain <b>text") == ["plain text"]
    assert html_extract.slots("<p>a <button>x</button> b</p><p title='1>0'>c</p>") == ["a b", "c"]
    assert html_extract.slots("") == [] == html_extract.slots("<body><article></article><p>other</p></body>")


def test_html_extract_template(spark):
    fixed = "<article><p>Always the same words.</p><p>{}</p></article>"
    rows = [(k, "http://Host.example/a", f"<html><body><nav>m</nav>{fixed.format(f'text {k}')}</body></html>") for k in range(12)]
    rows += [(100, "http://other.example/", PAGE.format("Five")), (101, None, None), (102, "http://h/", ""), (0, "http://Host.example/a", rows[0][2])]
    got = sorted((r.page_id, r.text) for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = [(k, f"text {k}") for k in range(12)] + [(0, "text 0"), (100, "T & x\nOne two three four\nFive\na\nb\ntail end"), (101, ""), (102, "")]
    assert got == sorted(want)
    assert html_extract.html_extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_extract_copies(spark):
    page = "<body><article><h1>Same</h1><p>One article.</p>{}</article></body>"
    rows = [(k, f"http://copies.example/{k}", page.format("")) for k in range(9)]  # one article under several URLs
    rows += [(20 + k, f"http://near.example/{k}", page.format(f"<aside>{k}</aside>")) for k in range(9)]  # differ beside the text only
    rows += [(40 + k % 7, "http://few.example/", page.format(f"<p>{k % 7}</p>")) for k in range(14)]  # seven pages, each twice
    got = html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted((i, "Same\nOne article." + (f"\n{i - 40}" if i >= 40 else "")) for i, _, _ in rows)


def test_html_extract_main_by_slots(spark):
    page = "<html><body><div>Our site</div><div class='x'><h2>T{0}</h2><p>Always the same words.</p><div><p>story {0} is told at length</p></div></div><div><p>seen {0}</p></div></body></html>"
    odd = ["<html><body><div>Our site</div><p>away</p></body></html>", "", None, " "]
    rows = [(k, "http://div.example/", page.format(k)) for k in range(12)] + [(20 + k, "http://div.example/", x) for k, x in enumerate(odd)]
    got = html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(k, f"T{k}\nstory {k} is told at length") for k in range(12)] + [(20, "away"), (21, ""), (22, ""), (23, "")]


def test_html_template_alone_finds_the_text(spark):
    """The driver's pages with no telling name or tag left: the template finds the same text, the pages by themselves do not."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    blank = F.regexp_replace("html", "</(nav|article|footer)>", "</div>")
    for tag, name in (("<nav>", "k"), ("<article>", "q"), ("<footer>", "r"), ('<div class="ad">', "z")):
        blank = F.replace(blank, F.lit(tag), F.lit(f'<div class="{name}">'))
    blank = pages.withColumn("html", blank)
    want = {r.page_id: r.text for r in html_extract.html_extract(pages).collect()}
    assert {r.page_id: r.text for r in html_extract.html_extract(blank).collect()} == want
    alone = {r.page_id: "\n".join(html_extract.slots(r.html)) for r in blank.collect()}
    assert all(alone[k] != want[k] for k in want)


def test_html_classes_brute_force(spark):
    """Fixed texts are those whose occurrence vector over the host's different pages is that of an element around them."""
    r = random.Random(8)
    rows = []
    for k in range(60):
        lines = "".join(f"<p>{r.choice(['one', 'two', 'three'])} {r.randrange(3)}</p>" for _ in range(r.randrange(1, 4)))
        note = "<p>always</p>" if r.random() < 0.9 else ""
        part = f"<div class='s'><p>label</p><ul>{'<li>item</li>' * r.randrange(1, 3)}</ul></div>" if r.random() < 0.8 else ""
        rows.append((k, f"http://h{k % 3}.example/{k}", f"<body><div class='t'>site</div>{part}<div class='m'><h2>head</h2>{lines}{note}</div></body>"))
    got = {t.host: set(t.fixed) for t in html_extract.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for host in ("h0.example", "h1.example", "h2.example"):
        pages = [html_extract.Page(x) for x in sorted({h for _, u, h in rows if host in u})]
        text, element = defaultdict(lambda: [0] * len(pages)), defaultdict(lambda: [0] * len(pages))
        for n, page in enumerate(pages):
            element[""][n] = 1
            for path in page.elements:
                element[path][n] += 1
            for path, _, _, t in page.blocks:
                text[path, t][n] += 1
        want = set()
        for (path, t), v in text.items():
            support = sum(map(bool, v))
            if support >= html_extract.LEAST_SUPPORT and 2 * support >= len(pages) and any(element[x] == v for x in (path, *html_extract._above(path))):
                want.add(html_extract._token(path, t))
        assert got[host] == want and want


def test_html_clashing_names_and_many_hosts(spark, monkeypatch):
    page = "<body><div class='t'>site</div><div class='m'><p>{0}</p><p>more {0}</p></div></body>"
    rows = [(k, f"http://h{k % 2}.example/", page.format(k), "a", k, "b", "c") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, pages long, main string, fixed string")
    keep = ("page_id", "host", "pages", "main", "fixed")
    want = [(k, "a", k, "b", "c", f"{k}\nmore {k}") for k in range(40)]
    assert sorted((*[r[x] for x in keep], r.text) for r in html_extract.html_extract(df, keep_columns=keep).collect()) == want
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(html_extract, "PAGES_A_PART", 7)
    assert sorted((*[r[x] for x in keep], r.text) for r in html_extract.html_extract(df, keep_columns=keep).collect()) == want


# 3. packing


def test_plan_places_every_piece_gapless():
    r = np.random.default_rng(3)
    for _ in range(25):
        capacity = int(r.integers(5, 60))
        counts = {int(s): int(r.integers(1, 30)) for s in r.integers(1, capacity + 1, 12)}
        plan = packing.Plan(counts, capacity)
        places, held = plan.places(), defaultdict(list)
        for s, n in counts.items():
            for rank in range(n):
                row = places[s][np.searchsorted(places[s][:, 0], rank, side="right") - 1]
                at = rank - row[0]
                held[int(row[1] + at // row[2])].append((int(row[3] + at % row[2] * s), s))
        assert sorted(held) == list(range(plan.n_sequences))
        for items in held.values():
            end = 0
            for offset, s in sorted(items):
                assert offset == end
                end += s
            assert end <= capacity
        assert plan.n_sequences >= -(-sum(s * n for s, n in counts.items()) // capacity)


def best(sizes, capacity):
    """The least number of bins, by search."""
    sizes = sorted(sizes, reverse=True)
    for n in range(1, len(sizes) + 1):
        room = [capacity] * n

        def fit(k):
            if k == len(sizes):
                return True
            seen = set()
            for b in range(n):
                if room[b] >= sizes[k] and room[b] not in seen:
                    seen.add(room[b])
                    room[b] -= sizes[k]
                    if fit(k + 1):
                        return True
                    room[b] += sizes[k]
            return False

        if fit(0):
            return n


def test_reduction_keeps_a_best_packing():
    r = random.Random(5)
    for _ in range(40):
        sizes = [r.randrange(1, 20) for _ in range(9)]
        plan = packing.Plan(Counter(sizes), 20)
        plan.places()
        assert best(sizes, 20) <= plan.n_sequences <= best(sizes, 20) + 1
        reduced = packing.Plan.__new__(packing.Plan)
        reduced.capacity, reduced.bins = 20, []
        left = np.bincount(sizes, minlength=21)
        fixed = reduced._reduce(left)
        rest = [s for s in range(21) for _ in range(left[s])]
        assert fixed + (best(rest, 20) if rest else 0) == best(sizes, 20)  # what is fixed loses nothing


def test_encoder_gives_the_ids_of_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(*packing.public_byte_bpe())
    texts = ["<|endoftext|> x", "a<|endoftext|><|endoftext|>b ", "<|endoftext", "", " ", "12345 \n\n  x\u00a0y 漢字 \u200d🙂 it's IT'S", "a" * 3000, "\r\n\t \x00\x85\u2028"]
    texts += [t or "" for _, t in corpus(60)]
    points = [k for k in range(0x30000) if not 0xD800 <= k < 0xE000]  # letters, digits, spaces and others are told apart alike
    texts += ["".join(f"a{chr(k)}b 1{chr(k)}2 !{chr(k)}? {chr(k)} x {chr(k)}" for k in points[at : at + 512]) for at in range(0, len(points), 512)]
    assert [list(encode(t)) for t in texts] == [exact.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(encode("<|endoftext|> x"))[0] == exact.token_to_id("<|endoftext|>")


def test_pack_ranks_hot_lengths_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    rows = [(k, 0, 16 if k % 3 else 1 + k % 16, "old", 5) for k in range(3000)] + [(None, 0, 16, "old", 5), (1, 0, 16, "old", 5), (1, 0, 16, "old", 5)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, length long, sequence_id string, offset int")
    got = packing.pack(parts, 16).collect()
    assert packing.pack(parts, 16).columns == ["doc_id", "piece", "length", "sequence_id", "offset"] and len(got) == len(rows)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    assert sorted(held) == list(range(len(held))) and len(held) == -(-sum(r[2] for r in rows) // 16)
    for items in held.values():
        assert [x for x, _ in sorted(items)] == list(np.cumsum([0, *[n for _, n in sorted(items)]])[:-1]) and sum(n for _, n in items) <= 16
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 17)], "doc_id long, piece int, length long"), 16)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, None)], "doc_id long, piece int, length long"), 16)


def test_pack_documents(spark):
    path, pattern = packing.public_byte_bpe()
    ranks = packing.encoder(path, pattern)
    rows = [*corpus(60), (None, "no id"), (3, "again"), (900, "a" * 3000), (901, "<|endoftext|> 12345 \n\n  x\u00a0y 漢字")]
    got = packing.pack_documents(frame(spark, rows), path, pattern, capacity=256, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 256
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for items in by_sequence.values():
        end = 0
        for offset, n in sorted(items):
            assert offset == end
            end += n
        assert end <= 256
    for i, t in rows[:60]:
        parts = sorted(by_doc[i], key=lambda r: r.piece) if i != 3 else None
        if parts:
            assert [x for r in parts for x in r.ids] == [*ranks(t or ""), 0]
            assert [r.start for r in parts] == list(np.cumsum([0, *[r.length for r in parts]])[:-1])
    assert len(got) == sum(len(packing.cut_lengths(len(ranks(t or "")) + 1, 256)) for _, t in rows)
    assert packing.pack_documents(frame(spark, []), path, pattern).count() == 0


# 4. toxicity


def toxic_rows(n=400, seed=2):
    r = random.Random(seed)
    words = [f"word{k}" for k in range(800)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        text = [r.choice(words) for _ in range(60)] + (r.sample(["idiotic", "trashy", "scummy", "moronic"], 3) if bad else [])
        r.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad), int(i % 12 == 0)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    known = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, toxic int, quality int")
    docs = frame(spark, [*rows, (9001, None), (9002, ""), (None, "idiotic trashy scummy"), (9003, "idiotic")], "doc_id long, text string")
    model = toxicity.train(docs, toxicity.labelled(known.union(known)))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(docs.withColumn("severity", F.lit("clash")), model).collect()}
    want = {i: bool(t) for i, t, _ in labels}
    wrong = [i for i in want if i % 4 == 0 and (got[i].p_toxic >= toxicity.REJECT) != want[i]]
    assert len(wrong) <= 2
    assert got[9001].p_toxic == got[9002].p_toxic < 0.5 and 0 <= got[9001].severity <= 2
    assert len(got) == len(rows) + 4


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b")])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert toxicity.score(docs, model).first().p_toxic < 0.5


def test_ordinal_gradient_fits_ordered_grades():
    rows = [np.array([1, 5]) if g == 2 else np.array([1]) if g else np.array([9]) for g in [0, 1, 2] * 60]
    model = toxicity.fit(rows, np.array([0, 1, 2] * 60), 3)
    low, mid, high = (model.beyond(np.array([model.weights[x].sum()])).sum() for x in ([9], [1], [1, 5]))
    assert low < mid < high


def test_ordinal_gradient_against_differences():
    r = np.random.default_rng(2)
    score, raw, y, weight = r.normal(0, 2, 30), np.array([-0.4, 0.3, -0.2]), r.integers(0, 4, 30), r.uniform(0.5, 2, 30)
    _, g_score, g_raw = toxicity.likelihood(score, raw, y, weight)
    for x, g in ((score, g_score), (raw, g_raw)):
        for k in range(len(x)):
            kept, e = x[k], 1e-6
            x[k] = kept + e
            up = toxicity.likelihood(score, raw, y, weight)[0]
            x[k] = kept - e
            down = toxicity.likelihood(score, raw, y, weight)[0]
            x[k] = kept
            assert abs((up - down) / (2 * e) - g[k]) < 1e-6


def test_toxicity_of_the_driver_labels_held_out(spark):
    """Fitted on the labels of even ids, judged on those of odd ids: few are missed or wrongly rejected in any language, and severity rises with the grade."""
    d = "/root/testdata/sf0.1"
    docs, grades = spark.read.parquet(f"{d}/documents.parquet"), toxicity.labelled(spark.read.parquet(f"{d}/labels.parquet"))
    model = toxicity.train(docs, grades.filter("doc_id % 2 = 0"))
    sound = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    odd = docs.join(grades.filter("doc_id % 2 = 1"), "doc_id").join(sound, "doc_id").select("doc_id", "lang", "grade", "quality", "text")
    rows = toxicity.score(odd, model).collect()
    toxic = [r for r in rows if r.grade == 2]
    assert np.mean([r.p_toxic >= toxicity.REJECT for r in toxic]) >= 0.9
    for lang in ("en", "de", "fr", "es"):
        own = [r for r in rows if r.lang == lang]
        # the text of a poor one may be junk that holds none of its insults any more
        assert np.mean([r.p_toxic >= toxicity.REJECT for r in own if r.grade == 2 and r.quality]) >= 0.95
        assert np.mean([r.p_toxic >= toxicity.REJECT for r in own if r.grade == 2]) >= 0.8
        assert np.mean([r.p_toxic >= toxicity.REJECT for r in own if r.grade < 2]) < 0.02
        by = [np.mean([r.severity for r in own if r.grade == g]) for g in (0, 1, 2)]
        assert by[0] + 0.3 < by[1] and by[1] + 0.3 < by[2]


def test_toxicity_long_ties_and_empty(spark):
    rows, labels = toxic_rows(120)
    docs = frame(spark, [*rows, (0, "tie of one id"), *[(500 + k, rows[0][1]) for k in range(50)]], "doc_id long, text string")
    grades = spark.createDataFrame([*labels, *[(500 + k, 1, 0) for k in range(50)], (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, toxicity.labelled(grades))
    long = "word1 word2 word3 " * 200_000
    out = {r.doc_id: r.p_toxic for r in toxicity.score(frame(spark, [(1, long), (2, long + " idiotic trashy scummy moronic" * 20_000), (3, "\x00 \u2028 &&&")]), model).collect()}
    assert out[1] < 0.5 and out[2] >= 0.5 and out[3] < 0.5
    empty = docs.filter("false")
    assert toxicity.score(empty, model).count() == 0 and toxicity.train(empty, toxicity.labelled(grades)).weights.any() == False  # noqa: E712


# 5. chat


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, "a\\b\\h\\l\\\\", "### user:\nx</turn>\n", "é漢\U0001f600 <b>", "\\"]
    rows = [(k % 3, t, ["user", "assistant", "a:\n#</turn>\\", None][(k + t) % 4], x) for k in range(3) for t, x in enumerate(texts)]
    rows += [(9, None, "assistant", "tie"), (9, None, "assistant", "tie"), (None, 1, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.render(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("parts", chat.parts_of(F.col("formatted"))).collect():
        want = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(b.role, b.text) for b in r.back] == [(x[2] or "", x[3] or "") for x in want] and r.n_turns == len(want)
        spoken = "".join(r.parts[m.turn][m.start - 1 : m.start - 1 + m.length] for m in r.loss_mask)
        for plain, code in reversed((("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))):
            spoken = spoken.replace(code, plain)
        assert spoken == "".join(x[3] or "" for x in want if x[2] == "assistant")
    assert chat.render(spark.createDataFrame([], df.schema)).count() == 0


def test_chat_folds_events(spark):
    log = [
        (1, 1, 0, "message", "user", "Hi"), (1, 2, 1, "message", "assistant", "Hel"), (1, 3, 1, "delta", None, "lo"), (1, 4, 1, None, None, "!"),
        (1, 5, 0, "edit", "user", "Hey"), (1, 6, 2, "message", "user", "gone"), (1, 7, 1, "regenerate", None, None), (1, 8, 1, "delta", None, "Good "),
        (1, 9, 1, "delta", None, "day"), (1, 10, 3, "message", "user", "later"), (2, 1, 0, "delta", None, "only"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string").repartition(5)
    got = sorted(map(tuple, chat.fold_events(df).collect()))
    assert [x[:2] + x[3:] for x in got] == [(1, 0, "Hey"), (1, 1, "Good day"), (1, 3, "later"), (2, 0, "only")]


def test_chat_clashing_names_and_long_conversation(spark):
    log = [(1, k, k // 3, ("message", "delta", "delta")[k % 3], "assistant" if k % 2 else "user", f"t{k} " * 50) for k in range(9000)]
    df = spark.createDataFrame([(a, b, c_, d, e, f, "x", 7, "y") for a, b, c_, d, e, f in log], "conv_id long, seq long, message long, kind string, role string, text string, turns string, parts int, formatted string")
    got = chat.chat_format(df.repartition(6)).first()
    assert got.n_turns == 3000 and got.formatted.startswith("### user:\n" + log[0][5] + log[1][5] + log[2][5] + "</turn>\n")


# 6. Jaccard


def components(rows, words=5, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    flat = [(i, s) for i, x in sets.items() for s in x if i is not None and s]
    for a, (i, x) in enumerate(flat):
        for j, y in flat[:a]:
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), root(i) if i is not None else None) for i, x in sets.items() for s in x), key=str)


def chain(n=40, length=60):
    """Near copies that link only step by step."""
    words = [f"c{k}" for k in range(length + 2 * n)]
    return [(5000 + k, " ".join(words[2 * k : 2 * k + length])) for k in range(n)]


@pytest.mark.parametrize("region,rounds", [(jaccard_join.REGION_SHINGLES, 4), (1500, 4), (1500, 0), (300, 1)])
def test_jaccard_join_brute_force(spark, monkeypatch, region, rounds):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    by_pivot, apart = jaccard_join._by_pivot, []
    monkeypatch.setattr(jaccard_join, "_by_pivot", lambda *a: apart.append(by_pivot(*a)) or apart[-1])
    rows = [*corpus(), *chain(), (3, "another text of the id three which is longer than that"), (None, "x y z"), (700, "A b C"), (701, "a B c"), (702, "a b")]
    r = random.Random(4)
    base = [f"n{k}" for k in range(90)]
    for k in range(120):  # a group of near copies
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(90)] = f"e{r.randrange(50)}"
        rows.append((8000 + k, " ".join(w)))
    got = jaccard_join.jaccard_join(frame(spark, rows), region_shingles=region)
    assert sorted(map(tuple, got.collect()), key=str) == components(rows)
    assert (apart[0] is not None) or rounds  # without a round it is the single pivots that divide


def test_region_recursion_is_exact():
    r = random.Random(6)
    sets = []
    for _ in range(12):
        base = r.sample(range(3000), 60)
        for _ in range(45):
            x = set(base)
            for _ in range(r.randrange(14)):
                x.discard(r.choice(base))
                x.add(r.randrange(3000))
            sets.append(np.array(sorted(x), np.uint64))
    got = jaccard_join.join_region(sets)
    python = [set(x.tolist()) for x in sets]
    parent = list(range(len(sets)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(python[a] & python[b]) >= 80 * len(python[a] | python[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    assert got.tolist() == [root(i) for i in range(len(sets))]


def test_near_copies_cost_no_square(monkeypatch):
    """Copies of one text with 0 to 20 of 100 shingles changed, many of them beyond 0.8 of all others: before, a square of tests."""
    r = random.Random(9)
    sets = []
    for _ in range(3000):
        x = list(range(100))
        for at in r.sample(x, r.randrange(21)):
            x[at] = 100 + 40 * at + r.randrange(40)
        sets.append(np.array(sorted(x), np.uint64))
    read, shared = [0], jaccard_join._Region.shared

    def counted(region, i, others):
        read[0] += len(others)
        return shared(region, i, others)

    monkeypatch.setattr(jaccard_join._Region, "shared", counted)
    got = jaccard_join.join_region(sets)
    assert read[0] < 100 * len(sets)
    one = np.zeros((len(sets), 4100), np.float32)
    for k, x in enumerate(sets):
        one[k, x.astype(int)] = 1
    both = one @ one.T
    links = 100 * both >= 80 * (200 - both)
    want = np.arange(len(sets))
    while True:
        new = np.where(links, want, len(sets)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert got.tolist() == want.tolist() and len(set(got.tolist())) > 100


def test_blocks_of_a_region_meet_in_bounded_parts(spark):
    rows = [(7, k, 50, b"") for k in range(400)] + [(8, 1000 + k, 50, b"") for k in range(20)]
    sets = spark.createDataFrame(rows, "region long, id long, n long, shingles binary")
    parts = {}
    for x in jaccard_join._block_pairs(sets, 4000).collect():
        parts.setdefault((x.region, x.part), set()).add(x.id)
    assert parts.pop((8, 0)) == {1000 + k for k in range(20)}
    assert all(50 * len(x) < 1.5 * 4000 for x in parts.values())
    assert {(a, b) for x in parts.values() for a in x for b in x} == {(a, b) for a in range(400) for b in range(400)}


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0
    df = frame(spark, [(1, "a b c d e f", 0), (2, "a b c d e f", 0), (None, "a b c d e f", 0)], "doc_id long, text string, component_id int")
    assert sorted(str(r.doc_id) for r in jaccard_join.keep_one(df).collect()) == ["1", "None"]


# 7. decontamination


def test_decontaminate(spark):
    r = random.Random(8)
    words = [f"t{k}" for k in range(3000)]
    items = [(k, " ".join(r.choice(words) for _ in range(15 + 9 * k))) for k in range(6)] + [(50, "too short"), (51, None), (None, "x " * 20)]
    fill = lambda n: [r.choice(words) for _ in range(n)]
    rows = [(1, " ".join(fill(80))), (2, None), (3, "")]
    for k, t in items[:6]:
        w = t.split()
        rows.append((10 + k, " ".join([*fill(9), *w, *fill(30)])))  # whole
        changed = list(w)
        for at in r.sample(range(len(w)), len(w) // 7):
            changed[at] = "other"
        rows.append((20 + k, " ".join([*changed, *fill(10)]).upper()))  # substituted
        rows.append((30 + k, " ".join([*fill(30), *w[: len(w) // 2]])))  # half
    rows += [rows[3], (None, items[0][1])]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(10 + k, k) for k in range(6)} | {(20 + k, k) for k in range(6)}
    left = sorted(str(x.doc_id) for x in decontaminate.decontaminate(docs, bench).collect())
    assert left == sorted(["1", "2", "3", "None", *[str(30 + k) for k in range(6)]])
    assert decontaminate.contaminated(docs, bench.filter("false")).count() == 0 == decontaminate.contaminated(docs.filter("false"), bench).count()


def test_decontaminate_any_case(spark):
    item = "l'été où école était fermée à Évreux, déjà prêts là-bas: ñandú über Öl groß straße maß"
    docs = frame(spark, [(1, f"avant {item.upper()} après"), (2, item.title()), (3, item.lower()), (4, item.replace("é", "e").replace("ß", "s").replace("à", "a"))])
    got = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_match, x.n_region) for x in got) == [(k, 16, 16) for k in (1, 2, 3)]


def test_decontaminate_short_items(spark):
    """Items of five to seven words count where all their words stand, shorter ones only as a whole document."""
    items = [(1, "one two three four five six"), (2, "Just two."), (3, "a")]
    rows = [(1, "x One two, three four five six y"), (2, "one two three four five other six"), (3, "just TWO"), (4, "it is just two words"), (5, "a"), (6, "a b"), (7, " ")]
    got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 6, 6), (3, 2, 2, 2), (5, 3, 1, 1)]


def test_decontaminate_long_and_both_plans(spark, monkeypatch):
    r = random.Random(9)
    book = [f"b{r.randrange(50_000)}" for _ in range(100_000)]
    rows = [(1, " ".join([f"d{k % 70_000}" for k in range(500_000)] + book[777:900] + [f"e{k % 70_000}" for k in range(500_000)])), (2, " ".join(book[:30])), (3, " ".join(book[5000:5100])), (4, "nothing of it " * 9)]
    rows += [(5, " ".join(book[100:160])), (5, "another text of the same id"), *[(10 + k, t) for k, t in corpus(80)]]
    items = [(7, " ".join(book)), (8, rows[12][1]), (9, "w1 w2 w3")]
    docs = frame(spark, [(*x, "a", "b") for x in rows], "doc_id long, text string, n_match string, __gl_item string")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_region int")
    got = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert {x[:2] for x in got if x[1] == 7} == {(1, 7), (3, 7), (5, 7)}
    for name in ("BROADCAST_SEEDS", "BROADCAST_BYTES"):
        monkeypatch.setattr(decontaminate, name, 0)
        assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == got


# 8. language


def test_language_id(spark):
    r = random.Random(9)
    kinds = {"aa": ["kala", "mora", "tiku", "sano"], "bb": ["schwert", "zug", "über", "pfad"], "cc": ["çava", "été", "eaux", "ouvre"]}
    rows = [(i, " ".join(r.choice(kinds[k]) + r.choice(["", "n", "r"]) for _ in range(30)), k, "s", 1) for i, k in enumerate(sorted(kinds) * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "aa", "s", 1), (901, "123 ... 4", "bb", "s", 1), (902, "kala mora", None, "s", 1), (None, "schwert zug", None, "s", 1)], DOCS)
    net = language_id.train(docs.filter(~language_id.held_out()), batches=120)
    out = language_id.identify(docs.withColumn("held_out", language_id.held_out()).withColumn("score", F.lit("clash")), net).collect()
    own = [x for x in out if x.held_out and x.lang and x.text and x.doc_id < 900]
    assert np.mean([x.lang_pred == x.lang for x in own]) >= 0.95
    assert {x.doc_id: x.held_out for x in out}[4] == (zlib.crc32(b"4") % 4 == 2)
    by = {x.doc_id: x for x in out}
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[902].lang_pred == "aa" and by[None].lang_pred == "bb" and not by[None].held_out
    assert all(0 <= x.score <= 1 for x in out)
    empty = language_id.train(docs.filter("false"))
    assert language_id.identify(docs, empty).first().lang_pred == "und"


def test_network_gradient():
    """Backpropagation through time against central differences, in double precision; and training lowers the loss."""
    net = language_id.start(["a", "b", "c"], dtype=np.float64)
    rows, y = [b"abc d", b"xyzzy pl ugh", b"a", "é ß".encode()], np.array([0, 1, 2, 1])
    _, grads = language_id.gradients(net, rows, y)
    r = np.random.default_rng(4)
    seen = sorted(set(b"".join(rows)))
    for p, g in zip((net.x, net.u, net.o, net.b), grads, strict=True):
        for _ in range(25):
            at = tuple(int(r.integers(0, n)) for n in p.shape)
            if p is net.x:
                at = (at[0], int(r.choice(seen)), at[2])
            kept, e = p[at], 1e-5
            p[at] = kept + e
            up = language_id.gradients(net, rows, y)[0]
            p[at] = kept - e
            down = language_id.gradients(net, rows, y)[0]
            p[at] = kept
            assert abs((up - down) / (2 * e) - g[at]) < 1e-7 + 1e-4 * abs(g[at])
    pieces = {"a": [b"abc aab", b"aab abc abc"], "b": [b"xyz zzx", b"zzx xyz xyz"]}
    net = language_id.fit(pieces, batches=60, rows=64)
    p = net.pooled([b"abc aab", b"xyz"])
    assert p[0, 0] > 0.9 and p[1, 1] > 0.9


def test_network_reads_whole_texts(monkeypatch):
    """Every position is labelled once, with the bytes around it, however long a text without a blank is."""
    net = language_id.start(["a", "b"])
    r = np.random.default_rng(5)
    texts = [bytes(r.integers(97, 123, n).tolist()) for n in (1, 40, 300, 0, 2000)] + ["漢字ü".encode() * 70]

    def labels(text):
        data, active, _ = language_id._padded([text])
        return net.label(np.concatenate([net.run(0, data, active), net.run(1, data, active)], axis=2))[:, 0]

    whole = [labels(t).mean(axis=0) if t else np.zeros(2) for t in texts]
    got = net.pooled(texts)
    assert np.allclose(got[:3], whole[:3], atol=1e-5) and np.allclose(got.sum(axis=1), [1, 1, 1, 0, 1, 1])
    monkeypatch.setattr(language_id, "WINDOW", 50)
    monkeypatch.setattr(language_id, "ROWS", 7)
    for t, p in zip(texts, net.pooled(texts), strict=True):
        parts = [labels(t[max(0, k - 32) : k + 82])[k - max(0, k - 32) :][:50] for k in range(0, len(t), 50)]
        assert np.allclose(p, np.concatenate(parts).mean(axis=0) if t else 0, atol=1e-5)


def test_language_pieces():
    assert language_id.pieces_of("") == [] == language_id.pieces_of("12 ... " * 90) and language_id.pieces_of("a1") == [b"a1"]
    text = "".join(chr(0x4E00 + k) for k in range(5000))  # no blank at all
    pieces = language_id.pieces_of(text)
    at = [text.index(p.decode(errors="ignore")[:15]) for p in pieces]
    assert len(pieces) == language_id.PIECES and at[0] == 0 and at[-1] > 4900 and np.diff(at).max() < 600
    assert all(len(p) <= language_id.PIECE for p in pieces)


def test_language_sample_with_repeated_ids(spark):
    """Rows that share an id, or have none, are sampled row by row."""
    rows = [(i, (f"schwert zug {k}" if k % 2 else f"kala mora {k}"), "bb" if k % 2 else "aa") for i in (None, 5) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for part in (docs.filter("doc_id is null"), docs.filter("doc_id = 5")):
        net = language_id.train(part, sample=100, batches=80)
        assert net.languages == ["aa", "bb"] and {(x.lang, x.lang_pred) for x in language_id.identify(part, net).collect()} == {("aa", "aa"), ("bb", "bb")}
    for i in range(1, 7):
        same = spark.createDataFrame([(i, k) for k in range(100)], "doc_id long, k int")
        assert 0 < c.hash_sample(same, F.xxhash64("doc_id", "k"), 10, ["k"]).count() <= 10 == c.hash_sample(same, F.col("doc_id"), 10, ["k"]).count()


def test_language_long_text_and_empty_table(spark):
    net = language_id.fit({"a": [b"abc aab"], "b": [b"xyz zzx"]}, batches=60, rows=64)
    docs = spark.createDataFrame([(1, "abcaab" * 50_000), (1, "xyzzzx" * 50_000), (2, ""), (3, None)], "doc_id long, text string")
    assert [x.lang_pred for x in language_id.identify(docs, net).collect()] == ["a", "b", "und", "und"]
    assert language_id.identify(docs.filter("false"), net).count() == 0


# 9. resharding


def test_min_cost_flow():
    flow = resharding.min_cost_flow([10, 2, 6], [6, 6, 6], [[0 if i == j else 1 for j in range(3)] for i in range(3)])
    assert [sum(x) for x in flow] == [10, 2, 6] and [sum(x[j] for x in flow) for j in range(3)] == [6, 6, 6]
    assert sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == 4
    costs = [[1, 9], [2, 3]]
    flow = resharding.min_cost_flow([5, 5], [5, 5], costs)
    assert sum(flow[i][j] * costs[i][j] for i in range(2) for j in range(2)) == 20


def test_assign_moves_few_bytes():
    r = random.Random(5)
    for _ in range(60):
        n_old, n_new = r.choice([(2, 3), (3, 2), (2, 2), (3, 3)])
        units = {k: [r.choice([0, r.randrange(1, 30)]) for _ in range(n_old)] for k in range(r.randrange(1, 7))}
        units = {k: x if sum(x) else [1] + [0] * (n_old - 1) for k, x in units.items()}
        new, _ = resharding.assign(units, n_old, n_new)
        assert set(new) == set(units)

        def cost(choice):
            load = [0] * n_new
            for k, j in choice.items():
                load[j] += sum(units[k])
            return max(load) - min(load), sum(sum(units[k]) - (units[k][j] if j < n_old else 0) for k, j in choice.items())

        spread, moved = cost(new)
        largest = max(map(sum, units.values()))
        assert spread <= largest
        least = min(m for s, m in (cost(dict(zip(units, x, strict=True))) for x in itertools.product(range(n_new), repeat=len(units))) if s <= spread)
        assert moved <= least + 2 * largest


def test_reshard(spark, tmp_path):
    rows = [*corpus(400), (1, "w"), (None, None), (None, None)]
    docs = frame(spark, rows)
    out = resharding.reshard(docs, n_new=4, n_old=3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert sorted(by) == [0, 1, 2, 3]
    sizes = [sum(r.size for r in x) for x in by.values()]
    longest = max(r.size for r in out)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    assert max(sizes) - min(sizes) <= longest
    assert resharding.reshard(frame(spark, [])).count() == 0


def test_reshard_a_given_layout(spark):
    """Shards by id, from 6 to 8: what moves is near the least, and equal texts end in one shard."""
    r = random.Random(3)
    rows = [(k, " ".join(r.choice("abcdefgh") * 5 for _ in range(r.randrange(5, 80)))) for k in range(3000)]
    rows += [(3000 + k, "same text " * 900) for k in range(6)] + [(4000 + k, f"pair {k // 2}") for k in range(200)]
    docs = frame(spark, rows).withColumn("old", F.pmod("doc_id", F.lit(6)))
    out = resharding.reshard(docs, n_new=8, n_old=6, old_col="old").collect()
    total = sum(x.size for x in out)
    load = Counter()
    for x in out:
        load[x.shard] += x.size
    assert max(load.values()) - min(load.values()) < total / 8 / 32
    have = Counter()
    for x in out:
        have[x.old_shard] += x.size
    groups = defaultdict(Counter)
    for x in out:
        groups[x.text_crc32, x.size][x.old_shard] += x.size
    gathered = sum(sum(g.values()) - max(g.values()) for g in groups.values())
    least = sum(max(0, have[i] - total / 8) for i in range(6))
    moved = sum(x.size for x in out if x.shard != x.old_shard)
    assert moved <= least + gathered + max(sum(g.values()) for g in groups.values())
    shards = defaultdict(set)
    for x in out:
        shards[x.text_crc32, x.size].add(x.shard)
    assert all(len(x) == 1 for x in shards.values())


def test_reshard_large_groups(spark):
    """A group that fits a shard is whole; one that is more than a shard is dealt out evenly."""
    rows = [(k, f"text {k} " * 10) for k in range(900)] + [(1000 + k, "equal " * 25) for k in range(70)]
    out = resharding.reshard(frame(spark, rows)).collect()
    assert len({x.shard for x in out if x.doc_id >= 1000}) == 1
    rows = [(k, f"text {k} " * 10) for k in range(300)] + [(1000 + k, "equal " * 25) for k in range(700)]
    out = resharding.reshard(frame(spark, rows)).collect()
    load = Counter()
    for x in out:
        load[x.shard] += x.size
    assert len(load) == 8 and max(load.values()) < 1.2 * min(load.values())


def test_rewrite_keeps_all_rows(spark, tmp_path):
    rows = [(i, t, "x", i) for i, t in [*corpus(100), (1, "w"), (1, "w"), (None, None), (None, "no id"), (None, "no id")]]
    docs = frame(spark, rows, "doc_id long, text string, shard string, slot long")
    placed = resharding.reshard(docs, n_new=4, n_old=3, keep_columns=True)
    shards = resharding.rewrite(placed, str(tmp_path / "out"))
    back = resharding.read_shards(placed, str(tmp_path / "out"), shards)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t) for i, t, *_ in rows)
    narrow = resharding.reshard(docs, n_new=4, n_old=3)
    key = lambda r: (str(r.doc_id), r.size, r.text_crc32, r.shard)
    assert Counter(map(key, back.collect())) == Counter(map(key, narrow.collect()))
    files = spark.read.parquet(str(tmp_path / "out"))
    assert files.count() == placed.filter(F.col("shard").isin(shards)).count()
    still = frame(spark, [(0, "a"), (1, "a ")]).withColumn("old", F.col("doc_id"))
    placed = resharding.reshard(still, n_new=2, n_old=2, old_col="old", keep_columns=True)
    assert resharding.rewrite(placed, str(tmp_path / "none")) == [] and resharding.read_shards(placed, "", []).count() == 2


# 10. quality


def figures(t):
    w = [x.decode() for x in split(t)]
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + o for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for o in range(3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_repeats_with_like_hashes(spark):
    """Two windows that agree in the upper 40 bits of their hashes, by turns."""
    one, two = "w1507636 p q", "w3302353 p q"
    got = quality_rules.quality_figures(frame(spark, [(1, f"{one} x {two} y {one} z {two}")])).first()
    assert (got.n_words, got.n_repeat_words) == (15, 12)


def test_quality_figures(spark):
    rows = [*corpus(), (600, "a b c a b c a b"), (601, "x\ny\nx\n\n \nx"), (602, "a a a a"), (603, "#*$ <b> & %|"), (604, "a b c"), (605, "a b"), (None, "1 2 3 1 2 3")]
    got = quality_rules.quality_figures(frame(spark, rows)).collect()
    want = Counter((i, *figures(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, [(1, "the cat and the dog " * 3 + " ".join(f"word{k}" for k in range(60))), (2, "%%% " * 80), (3, None)])).collect()}
    assert kept == {1: True, 2: False, 3: False}


def test_quality_empty_clashing_and_long(spark):
    long = "der die das und " * 250_000 + "eins zwei drei"
    docs = spark.createDataFrame([(1, long, 5, "k", True), (1, "", 5, "k", True), (None, None, 5, "k", True)], "doc_id long, text string, n_words int, h string, kept boolean")
    got = sorted(tuple(r)[:7] for r in quality_rules.quality_rules(docs).collect() if r.doc_id)
    assert got == [(1, 0, 0, 0, 0, 0, 0), (1, 1_000_003, 3 * 1_000_000 + 12, 0, 1, 0, 1_000_000)]
    assert quality_rules.quality_rules(docs.filter("false")).count() == 0


# the pipeline


def test_pipeline_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    rows, labels = toxic_rows(200)
    bench = " ".join(f"bench{k}" for k in range(30))
    extra = [(1000, rows[1][1] + " tail"), (1001, rows[2][1]), (1002, "start " + bench + " end of it"), (1003, rows[3][1][:150] + " " + " ".join(f"u{k}" for k in range(60))), (1004, None), (1005, "")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows + extra]
    d = str(tmp_path)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    table, current = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, table, d)
        if k < 4:
            assert out.columns == table.columns
            out.write.parquet(f"{d}/stage{k}")
            table = spark.read.parquet(f"{d}/stage{k}")
        current[name] = out.collect()
    toxic = {i for i, t, _ in labels if t}
    kept = {r.doc_id: r.text for r in current["toxicity"]}
    assert set(kept) == {x[0] for x in docs} - toxic
    of = {i: comp for i, _, comp in components(list(kept.items()))}
    kept = {i: t for i, t in kept.items() if of[i] == i}
    assert {r.doc_id: r.text for r in current["ngram_jaccard_join"]} == kept
    cut = {i: (kept[i] if not n else left) for i, m, n, left in removed(list(kept.items())) if not n or n < m}
    assert {r.doc_id: r.text for r in current["substring_dedup"]} == cut
    cut.pop(1002)
    assert {r.doc_id: r.text for r in current["benchmark_decontamination"]} == cut
    encode = packing.encoder(*packing.public_byte_bpe())
    assert sum(r.length for r in current["best_fit_packing"]) == sum(len(encode(t or "")) + 1 for t in cut.values())
    assert sorted(map(tuple, p.run(spark, d).drop("sequence_id", "offset").collect())) == sorted(tuple(r)[:5] for r in current["best_fit_packing"])


def test_pipeline_empty_and_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    rows, labels = toxic_rows(60)
    for name, docs in (("empty", []), ("odd", [*((i, t, "en", "s", 1) for i, t in rows), (None, rows[1][1], None, None, None), (None, None, None, None, None), (1, rows[1][1], "en", "s", 1), (2, "another text of the id", "en", "s", 1)])):
        d = str(tmp_path / name)
        spark.createDataFrame(docs, DOCS).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels if docs else [], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(0, "never there at all in any of these texts")] if docs else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        before = c.folders()
        got = Counter(r.doc_id for r in p.run(spark, d).collect())
        assert c.folders() <= before + 3  # what the stages leave is deleted
        if docs:
            toxic = {i for i, t, _ in labels if t}
            assert set(got) == {i for i, *_ in docs} - toxic and got[None] == 2 and got[1] == 2 and got[2] == 2
        else:
            assert not got


def test_hash_codec():
    x = np.array([0, 3, 3 + 255, 10_000, 10_001], np.int64)
    assert c.unpack_deltas(c.pack_deltas(x)).tolist() == x.tolist()
    h = np.array([1, 2**63 + 5], np.uint64)
    assert (c.uncut(c.cut(h, 7), 7) == (h & np.uint64(2**56 - 1))).all()
    assert hashlib.sha256(b"").hexdigest()  # the digest of no words
