import random

import pytest

from opsloom.operators import chunking as K


def _prose(seed, n):
    rng = random.Random(seed)
    seps = [" ", " ", " ", ". ", "\n", "\n\n"]
    return "".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12))) + rng.choice(seps) for _ in range(n))


@pytest.mark.parametrize("size, overlap", [(100, 20), (50, 0), (30, 10)])
def test_splitter_invariants(size, overlap):
    for seed in range(5):
        text = _prose(seed, 300)
        chunks = K.split_recursively(text, size, overlap, K.PROSE_SEPARATORS)
        assert all(0 < len(c) <= size for c in chunks)
        assert all(c in text and c == c.strip() for c in chunks)
        # nothing but white space is lost, and no more than the overlap is repeated
        bare = "".join(text.split())
        at = 0
        for c in ("".join(c.split()) for c in chunks):
            back = next(o for o in range(overlap + 1) if bare.startswith(c, at - o))
            at += len(c) - back
        assert at == len(bare)


def test_splitter_cases():
    split = K.split_recursively
    assert split("", 10, 2, K.PROSE_SEPARATORS) == []
    assert split("short", 10, 2, K.PROSE_SEPARATORS) == ["short"]
    assert split("aaa bbb ccc", 7, 0, K.PROSE_SEPARATORS) == ["aaa", "bbb", "ccc"] or split("aaa bbb ccc", 8, 0, K.PROSE_SEPARATORS) == ["aaa bbb", "ccc"]
    assert split("aa bb cc dd", 6, 3, K.PROSE_SEPARATORS) == ["aa bb", "bb cc", "cc dd"]
    assert split("x" * 25, 10, 0, K.PROSE_SEPARATORS) == ["x" * 10, "x" * 10, "x" * 5]
    # no separator left to try: an oversize piece stays whole
    assert split("y" * 30, 10, 0, K.CONFIG_SEPARATORS) == ["y" * 30]
    # a separator stays in front of the piece it starts
    assert split("a" * 8 + ". " + "b" * 8, 10, 0, K.PROSE_SEPARATORS) == ["a" * 8, ". " + "b" * 8]


def _pack(items, limit, extra, joiner, carry):
    packs, cur, n = [], [], 0
    for item in items:
        if n + len(item) + extra > limit and cur:
            packs.append(joiner.join(cur))
            cur = cur[-1:] if carry else []
            n = sum(len(c) for c in cur)
        cur.append(item)
        n += len(item) + extra
    return packs + [joiner.join(cur)] if cur else packs


def test_packing_equals_a_plain_loop(one):
    import re

    texts = [_prose(s, 200) for s in range(4)] + ["", "one", "a. b! c? d", "z" * 500]
    got = one(lambda c: K.pack_sentences(c, 120), *texts)
    assert got == [_pack(re.split(r"(?<=[.!?])\s+", t), 120, 0, " ", True) for t in texts]
    got = one(lambda c: K.pack_lines(c, 90), *texts)
    assert got == [_pack(t.split("\n"), 90, 1, "\n", False) for t in texts]


def test_line_packs_cover_the_text(one):
    text = _prose(9, 400)
    (packs,) = one(lambda c: K.pack_lines(c, 200), text)
    assert "\n".join(packs) == text


def test_sections(one):
    body = "word " * 50
    text = f"{'intro ' * 40}\n1.2. Scope Of Work\n{body}\nsection 3: Fees\nshort\nAPPENDIX A: Extra\n{body}\nDefinitions:\n{body}"
    (sections,) = one(K.split_sections, text)
    assert [s.title for s in sections] == [None, "1.2. Scope Of Work", "section 3: Fees", "APPENDIX A: Extra", "Definitions:"]
    assert sections[2].body == "short" and sections[1].body == body.strip()


def test_preamble_needs_200_characters(one):
    tail = "\nSection 1: A\nx"
    short, exact, long = one(K.split_sections, "p" * 199 + tail, "p" * 200 + tail, "p" * 201 + tail)
    assert [len(s) for s in (short, exact, long)] == [1, 1, 2]
    (whole,) = one(K.split_sections, "  no headers at all ")
    assert whole[0].title is None and whole[0].body == "  no headers at all "


@pytest.fixture
def chunk(spark):
    def run(kind, text):
        docs = spark.createDataFrame([("d", text, kind)], "doc_id string, content string, document_type string")
        return K.chunk_documents(docs).orderBy("chunk_index").collect()

    return run


def test_semantic_chunks(chunk):
    long = " ".join(f"Sentence number {i} ends here." for i in range(150))
    rows = chunk("sla", f"Section 1: Big\n{long}\nSection 2: Tiny\nsmall\nSection 3: Mid\n{'m' * 300}")
    assert {r.chunk_strategy for r in rows} == {"semantic"}
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert {r.section_header for r in rows} == {"Section 1: Big", "Section 3: Mid"}
    big = [r.content for r in rows if r.section_header == "Section 1: Big"]
    assert len(big) > 1 and big[0].split(". ")[-1] == big[1].split(". ")[0] + "." or big[1].startswith(big[0].rsplit("Sentence", 1)[1][:5].strip() or "Sentence")


def test_semantic_falls_back_to_prose(chunk):
    rows = chunk("sla", "Section 1: A\ntoo short to keep")
    assert [r.chunk_strategy for r in rows] == ["prose"] and rows[0].content.startswith("Section 1")


def test_config_blocks(chunk):
    text = (
        "hostname r1\n!\ninterface ge0/1\n mtu 1500\n vlan 10\n!\ninterface ge0/2\n mtu 9000\ninterface ge0/1\n mtu 1500\n vlan 10\n"
        "!\nrouter bgp 1\n neighbor x\n!\npolicy-map gold\n class a\n!\naccess-list 10 permit any\n!\n[section:a]\nk=v\n[b]\nk=w\n"
    )
    rows = chunk("config", text)
    assert [(r.content.split("\n")[0], r.config_block_type) for r in rows] == [
        ("interface ge0/1", "interface"),
        ("interface ge0/2", "interface"),
        ("router bgp 1", "routing"),
        ("policy-map gold", "qos_policy"),
        ("vlan 10", "vlan"),
        ("access-list 10 permit any", "acl"),
        ("[section:a]", "ini_section"),
        ("[b]", "ini_section"),
    ]
    assert rows[-1].content == "[b]\nk=w"


def test_config_falls_back_to_splitter(chunk):
    rows = chunk("config", "\n".join(f"set system option {i}" for i in range(200)))
    assert len(rows) > 1 and {r.config_block_type for r in rows} == {"general"}
    assert all(len(r.content) <= 2000 for r in rows)


def test_large_block_is_packed_by_lines(chunk):
    block = "interface ge0/9\n" + "\n".join(f" description line {i}" for i in range(200))
    rows = chunk("config", block)
    assert "\n".join(r.content for r in rows) == block and all(len(r.content) <= 2000 for r in rows)


def test_markdown_and_types(chunk):
    rows = chunk("md", "# Title here\ntext\n\n" + "para " * 300)
    assert rows[0].section_header == "Title here" and rows[0].chunk_strategy == "markdown" and rows[-1].section_header is None
    sizes = {kind: max(len(r.content) for r in chunk(kind, "word " * 2000)) for kind in ("csv", "json", "txt")}
    assert sizes["csv"] <= 500 < sizes["txt"] <= 1000 < sizes["json"] <= 1500


def test_ids_and_overrides(spark):
    docs = spark.createDataFrame([("d1", "word " * 500, "txt"), ("d2", "", "txt")], "doc_id string, content string, document_type string")
    rows = K.chunk_documents(docs, prose_size=300, prose_overlap=0).collect()
    assert {r.document_id for r in rows} == {"d1"}
    assert all(r.chunk_id == f"d1_{r.chunk_index}" and len(r.content) <= 300 for r in rows)


@pytest.mark.parametrize("line, kind", [("Router ospf", "routing"), ("class-map x", "traffic_class"), ("  VLAN 1", "vlan"), ("ip route", "general")])
def test_block_type(one, line, kind):
    assert one(K.block_type, line + "\nmore") == [kind]


def test_no_headers_in_chunk(one):
    assert one(K.section_header, "plain", "####### seven", "x\n## Two  \ny") == [None, None, "Two"]


def _by_list(text, size, overlap, separators):
    """The splitter stated over whole lists of pieces."""
    out, window = [], []

    def close():
        joined = "".join(window).strip()
        out.extend([joined] if joined else [])

    def walk(body, marks):
        mark = next((m for m in marks if m in body), marks[-1])
        finer = marks[marks.index(mark) + 1 :] if mark in body else []
        head, *rest = body.split(mark) if mark else ["", *body]
        for piece in [p for p in [head, *(mark + r for r in rest)] if p]:
            if len(piece) < size:
                if window and len("".join(window)) + len(piece) > size:
                    close()
                    while window and (len("".join(window)) > overlap or len("".join(window)) + len(piece) > size):
                        window.pop(0)
                window.append(piece)
                continue
            close()
            window.clear()
            if finer:
                walk(piece, finer)
            else:
                out.append(piece)
        close()
        window.clear()

    if text:
        walk(text, separators)
    return out


def test_streamed_chunks_equal_lists(spark):
    texts = [_prose(s, 250) for s in range(6)] + ["", None, "\n\n", ". ", "x" * 700, "ab" * 400 + "\n\n" + "c " * 300]
    plans = [(60, 15, "prose"), (90, 0, "markdown"), (75, 30, "network_config")]
    rows = [(i, f"tag{i}", t, *plan) for i, t in enumerate(texts) for plan in plans] + [(0, "tag0", texts[0], *plans[0])]
    table = spark.createDataFrame(rows, "id int, tag string, t string, size int, overlap int, kind string")
    got = K.stream_chunks(table, ["id", "tag", "kind"], "t", "size", "overlap", "kind").collect()
    want = [(i, tag, k, n, c) for i, tag, t, s, o, k in rows for n, c in enumerate(_by_list(t, s, o, K._SEPARATORS[k]))]
    assert sorted(map(tuple, got)) == sorted(want)
    assert K.stream_chunks(table.limit(0), ["id"], "t", "size", "overlap", "kind").collect() == []


def test_a_long_text_is_split_in_bounded_memory():
    import tracemalloc

    text = "word " * 200_000
    tracemalloc.start()
    n = sum(1 for _ in K.iter_chunks(text, 1000, 200, K.PROSE_SEPARATORS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1_000 and peak < 1_000_000
