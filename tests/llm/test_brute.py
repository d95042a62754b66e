"""Each operator against a plain brute-force version, over edge cases and over the small test tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

from millrace.llm.queries import QUERIES

from .fixtures import CLASHING, EDGE, clashing, edge_docs, write


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """Folders: the small tables, edge cases with clashing columns, and empty tables."""
    edge, none = tmp_path_factory.mktemp("edge"), tmp_path_factory.mktemp("none")
    docs = clashing(edge_docs(spark))
    labels = spark.createDataFrame([(1, 1), (3, 1), (7, 0), (8, 0), (10, 1), (12, 0), (13, 1), (None, 1), (2, None), (7, 1)], "doc_id long, quality int")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for folder, cut in ((edge, False), (none, True)):
        for df, name in ((docs, "documents"), (labels, "labels"), (clashing(pages), "pages")):
            write(df.limit(0) if cut else df, folder, name)
    return {"small": sf_dir, "edge": str(edge), "none": str(none)}


PAGES = [
    *((i, f"http://a.example.com/{i}", f"<body><div><p>Site words here</p></div><article><h1>T{i}</h1><p>Copied line.</p><p>Own &amp; {i}<br>more</p><div class='comments'>no</div></article></body>") for i in range(8)),
    *((10 + i, f"https://B.example.com:80/{i}", f"<div class=z>Same bar</div><div><p>Body {i} a<b>b</b> c</p><script>x='</p>'</script><ul><li>one<li>two</ul></div><footer>f</footer>") for i in range(8)),
    (30, None, "<p>No url"),
    (31, "", None),
    (32, "http://c.example.com", ""),
    (33, "http://c.example.com", "<article><p>unclosed <b>bold<p>next &lt;tag&gt; &nbsp; x<!-- c --><nav>n</nav>"),
    (34, "http://c.example.com", "<" * 20_000 + "<p a='" + "x" * 20_000),
    (None, "http://c.example.com", "<div>" * 5_000 + "deep"),
    (33, "http://c.example.com", "<article><p>unclosed <b>bold<p>next &lt;tag&gt; &nbsp; x<!-- c --><nav>n</nav>"),
]


def result(spark, tables, where, name):
    df = QUERIES[name](spark, tables[where])
    rows = df.collect()
    return [r.asDict() for r in rows]


def documents(spark, tables, where):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables[where]}/documents.parquet").select("doc_id", "text").collect()]


def same(got, want):
    """As bags; got is cut to the columns of want."""
    names = list(want[0]) if want else []
    bag = lambda rows: collections.Counter(tuple(r[n] for n in names) for r in rows)
    assert bag(got) == bag(want) and len(got) == len(want)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tables, name):
    assert result(spark, tables, "none", name) == []


BOTH = pytest.mark.parametrize("where", ["small", "edge"])


@BOTH
def test_op2(spark, tables, where):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in documents(spark, tables, where):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append({"doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": sha(np.array(ids, "<u4").tobytes()), "decoded_sha256": sha(t.decode(ids, skip_special_tokens=False))})
    same(result(spark, tables, where, "op2_bpe_round_trip"), want)


def secrets(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


@BOTH
def test_op3(spark, tables, where):
    want = []
    for doc_id, text in documents(spark, tables, where):
        found = secrets(text or "")
        spans = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
        want.append({"doc_id": doc_id, **{f"n_{k}": sum(f[2] == k for f in found) for k in ("assign", "access", "hex")}, "base_sha256": sha(spans)})
    same(result(spark, tables, where, "op3_secret_scan"), want)


@BOTH
def test_op4(spark, tables, where):
    docs = documents(spark, tables, where)
    got = result(spark, tables, where, "op4_sharding")
    raw = lambda t: (t or "").encode()
    same(got, [{"doc_id": i, "size": len(raw(t)) + 8, "text_crc32": zlib.crc32(raw(t)), "law": "rows", "grown_shard": None} for i, t in docs])
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) and 0 <= k < 24 for k, s in slots.items())
    sizes = [len(slots[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(0, m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(2, m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(3, m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found)


@BOTH
def test_op5(spark, tables, where):
    want = []
    for doc_id, text in documents(spark, tables, where):
        found = personal(text or "")
        spans = ",".join(f"{k}:{s}:{e}" for _, s, e, k in found)
        want.append({"doc_id": doc_id, **{f"n_{k}": sum(f[3] == k for f in found) for k in ("email", "ip", "card", "phone")}, "base_sha256": sha(spans)})
    got = result(spark, tables, where, "op5_pii")
    same(got, want)
    for r in got:
        assert len([s for s in r["spans"].split(",") if s]) >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@BOTH
def test_op6(spark, tables, where):
    docs = [(i, fingerprint(t)) for i, t in documents(spark, tables, where)]
    group = list(range(len(docs)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (docs[a][1] ^ docs[b][1]).bit_count() <= 4:
                group[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    same(result(spark, tables, where, "op6_simhash_near_dedup"), [{"doc_id": i, "fingerprint": f"{f:016x}", "component_id": least.get(root(a))} for a, (i, f) in enumerate(docs)])


@BOTH
def test_op7(spark, tables, where):
    got = result(spark, tables, where, "op7_media_columns")
    want = []
    for i, t in documents(spark, tables, where):
        raw = (t or "").encode()
        whole = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append({"doc_id": i, "n_bytes": len(raw), "payload_bytes": len(whole), "payload_sha256": sha(whole), "tail_crc32": zlib.crc32(whole[-32:]), "width": 576, "height": len(whole) // 576})
    same(got, want)
    media = collections.defaultdict(set)
    for r in got:
        media[r["payload_sha256"]].add((r["media_sha256"], r["media_bytes"], r["feature"], r["shard"], r["offset"]))
    assert all(len(m) == 1 for m in media.values())


@BOTH
def test_op8(spark, tables, where):
    docs = [(i, sha(re.sub("[\x20\x09-\x0d]+", " ", t or ""))) for i, t in documents(spark, tables, where)]
    members = collections.defaultdict(list)
    for i, d in docs:
        members[d].append(i)
    keep = {d: min((i for i in m if i is not None), default=None) for d, m in members.items()}
    same(result(spark, tables, where, "op8_exact_dedup"), [{"doc_id": i, "keep_id": keep[d], "group_size": len(members[d]), "kept": i == keep[d], "text_sha256": d} for i, d in docs])


@BOTH
def test_op9(spark, tables, where):
    got = result(spark, tables, where, "op9_quality")
    want = [{"doc_id": i, "held_out": i is not None and zlib.crc32(str(i).encode()) % 3 == 1} for i, _ in documents(spark, tables, where)]
    same(got, want)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


@BOTH
def test_op10(spark, tables, where):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = collections.Counter()
    for i, text in documents(spark, tables, where):
        docs[i, np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    got = result(spark, tables, where, "op10_packing")
    sequences, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    assert sum(r["length"] for r in got) == sum(len(ids) // 4 * n for (_, ids), n in docs.items())
    for (i, ids), n in docs.items():
        pieces = by_doc[i, len(ids) // 4]
        mine = [p for p in pieces if zlib.crc32(ids[4 * p[0] : 4 * (p[0] + p[1])]) == p[2]]
        covered = collections.Counter(x for s, m, _ in mine for x in range(s, s + m))
        assert all(covered[x] >= n for x in range(len(ids) // 4))


def test_op1(spark, tables):
    got = {(r["page_id"], r["url"]): r for r in result(spark, tables, "edge", "op1_html_extraction")}
    assert len(result(spark, tables, "edge", "op1_html_extraction")) == len(PAGES)
    for i in range(8):
        assert got[i, f"http://a.example.com/{i}"]["text"] == f"T{i}\nCopied line.\nOwn & {i} more"
        assert got[10 + i, f"https://B.example.com:80/{i}"]["text"] == f"Body {i} ab c"
    assert got[30, None]["text"] == "No url" and got[31, ""]["text"] == "" == got[32, "http://c.example.com"]["text"]
    assert got[33, "http://c.example.com"]["text"] == "unclosed bold\nnext <tag> x"
    assert got[None, "http://c.example.com"]["text"] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_op1_small_pages(spark, tables):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{tables['small']}/pages.parquet").collect()}
    for r in result(spark, tables, "small", "op1_html_extraction"):
        assert r["text"] == article_of(pages[r["page_id"]])


def article_of(page):
    import html

    inner = page.split("<article>")[1].split("</article>")[0]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_clashing_columns_are_there(spark, tables):
    names = spark.read.parquet(f"{tables['edge']}/documents.parquet").columns
    assert all(c.split()[0] in names for c in CLASHING.split(", ")) and len(EDGE) == len(documents(spark, tables, "edge"))
