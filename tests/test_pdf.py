import random
import zlib

import pytest
from pyspark.sql import functions as F

from stratafolio.operators import pages
from stratafolio.sources import documents, pdf, registries


def obj(number, body):
    return f"{number} 0 obj ".encode() + body + b" endobj\n"


def stream(head, data):
    return b"<<" + head + b" /Length %d>> stream\n" % len(data) + data + b"\nendstream"


def file_of(*objects, kids=b"3 0 R", table=True):
    """A file with a catalogue, a tree and the given objects (number, body), and a cross-reference table."""
    out, places = b"%PDF-1.4\n", {}
    for number, body in ((1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type /Pages /Kids [" + kids + b"]>>"), *objects):
        places[number] = len(out)
        out += obj(number, body)
    if table:
        at, n = len(out), max(places) + 1
        rows = b"".join(b"%010d 00000 %s \n" % (places.get(k, 0), b"n" if k in places else b"f") for k in range(n))
        out += b"xref\n0 %d\n" % n + rows + b"trailer <</Root 1 0 R /Size %d>>\nstartxref\n%d\n%%%%EOF" % (n, at)
    return out


def page(contents=b"4 0 R", more=b""):
    return (3, b"<</Type /Page /Contents " + contents + more + b">>")


def texts(raw):
    return [p.text for p in pdf.pages_of(raw)]


def shown(content, more=b"", *objects):
    return texts(file_of(page(more=more), (4, stream(b"", content)), *objects))[0]


@pytest.mark.parametrize(
    "content, want",
    [
        (b"BT (Hello) Tj ET", "Hello"),
        (b"(a (nested) \\(escaped\\) \\\\ b) Tj", "a (nested) (escaped) \\ b"),
        (b"(octal \\101\\7z) Tj (line\\\nend) Tj", "octal A\x07z\nlineend"),
        (b"[(Wo) -20 (rd) 5.5 <73>] TJ (x) '  1 2 (y) \" ", "Words\nx\ny"),
        (b"<48 65 6C6> Tj", "Hel`"),
        (b"(not shown) Td (shown) Tj /F1 12 Tf", "shown"),
        (b"% (a comment) Tj\n(b) Tj", "b"),
        (b"BI /W 1 ID \x00(no) Tj\xff EI (after) Tj", "after"),
        (b"(  ) Tj () Tj (x) Tj", "x"),
        (b"<FEFF00E900E8> Tj", "éè"),
        (b"Tj TJ ' \" (a) TJ [1] Tj (z) Tj", "z"),
        (b"(open", ""),
        (b"[[[[(deep)]]]] TJ (x) Tj", "x"),
    ],
)
def test_operators(content, want):
    assert shown(content) == want


def test_order_follows_the_tree_and_pages_without_content_are_told():
    raw = file_of((7, b"<</Type /Pages /Kids [9 0 R 3 0 R] /Parent 2 0 R>>"), (3, b"<</Type /Page /Contents 4 0 R>>"), (4, stream(b"", b"(third) Tj")), (5, b"<</Type /Page /Contents [6 0 R 4 0 R]>>"), (6, stream(b"", b"(first) Tj")), (9, b"<</Type /Page>>"), kids=b"5 0 R 7 0 R 2 0 R")
    assert texts(raw) == ["first\nthird", None, "third"]


def test_streams_that_cannot_be_read_are_empty_pages():
    packed = zlib.compress(b"(packed) Tj")
    raw = file_of((3, b"<</Type /Page /Contents 4 0 R>>"), (4, stream(b"/Filter /FlateDecode", packed)), (5, b"<</Type /Page /Contents 6 0 R>>"), (6, stream(b"/Filter /FlateDecode", b"broken")), (7, b"<</Type /Page /Contents 8 0 R>>"), (8, stream(b"/Filter /LZWDecode", b"x")), (9, b"<</Type /Page /Contents 10 0 R>>"), (10, stream(b"/Filter [/AHx /Fl]", packed.hex().encode() + b">")), kids=b"3 0 R 5 0 R 7 0 R 9 0 R")
    assert texts(raw) == ["packed", "", "", "packed"]


def test_fonts_with_a_character_map_and_without():
    table = stream(b"", b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <4E2D> <0020> <0021> [<0058> <0059>] endbfrange")
    fonts = b"/Resources <</Font <</A 5 0 R>>>>"
    assert shown(b"/A 9 Tf <00010002 0011 0020 0021 0099> Tj /B 9 Tf (plain) Tj", fonts, (5, b"<</Type /Font /ToUnicode 6 0 R>>"), (6, table)) == "Afi丮XY�\nplain"
    found = pdf.pages_of(file_of(page(), (4, stream(b"", b"<C3C4C5C6C7> Tj"))))
    assert found[0].unmapped and not pdf.pages_of(file_of(page(), (4, stream(b"", b"(plain text \351) Tj"))))[0].unmapped


def test_forms_are_run_where_they_are_drawn():
    form = (5, stream(b"/Subtype /Form", b"(inside) Tj /X Do"))
    assert shown(b"(before) Tj /X Do (after) Tj", b"/Resources <</XObject <</X 5 0 R>>>>", form).split("\n")[::9] == ["before", "after"]


def compressed_file(predictor=False):
    """Objects in an object stream, found by a cross-reference stream."""
    inner = [(1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type /Pages /Kids [3 0 R]>>"), (3, b"<</Type /Page /Contents 4 0 R>>")]
    heads, body = b"", b""
    for number, b in inner:
        heads += b"%d %d " % (number, len(body))
        body += b + b" "
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += obj(4, stream(b"/Filter /FlateDecode", zlib.compress(b"(from an object stream) Tj")))
    at5 = len(out)
    out += obj(5, stream(b"/Type /ObjStm /N 3 /First %d /Filter /FlateDecode" % len(heads), zlib.compress(heads + body)))
    at6 = len(out)
    rows = [(0, 0, 0), (2, 5, 0), (2, 5, 1), (2, 5, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0)]
    table = [bytes([a]) + b.to_bytes(3, "big") + bytes([c]) for a, b, c in rows]
    if predictor:
        table = [b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above)) for row, above in zip(table, [bytes(5), *table])]
    head = b"/Type /XRef /W [1 3 1] /Size 7 /Root 1 0 R /Filter /FlateDecode" + (b" /DecodeParms <</Predictor 12 /Columns 5>>" if predictor else b"")
    return out + obj(6, stream(head, zlib.compress(b"".join(table)))) + b"startxref\n%d\n%%%%EOF" % at6


@pytest.mark.parametrize("predictor", [False, True])
def test_object_and_cross_reference_streams(predictor):
    raw = compressed_file(predictor)
    assert texts(raw) == ["from an object stream"]
    assert texts(raw.replace(b"startxref", b"startnone")) == ["from an object stream"]  # by a scan


def test_newer_sections_win_over_older_ones():
    raw = file_of(page(), (4, stream(b"", b"(old) Tj")))
    at = len(raw)
    new = raw + obj(4, stream(b"", b"(new) Tj"))
    end = len(new)
    assert texts(new + b"xref\n4 1\n%010d 00000 n \ntrailer <</Root 1 0 R /Prev %d>>\nstartxref\n%d\n" % (at, int(raw.split(b"startxref\n")[1].split()[0]), end)) == ["new"]
    assert texts(file_of(page(), (4, stream(b"", b"(scanned) Tj")), table=False)) == ["scanned"]
    assert texts(raw.replace(b"startxref\n", b"startxref\n9")) == ["old"]  # a wrong place: found by a scan


def test_what_streams_inflate_to_is_bounded(monkeypatch):
    monkeypatch.setattr(pdf, "MOST_INFLATED", 1 << 20)
    bomb = zlib.compress(bytes(50 << 20))
    raw = file_of((3, b"<</Type /Page /Contents 4 0 R>>"), (4, stream(b"/Filter /FlateDecode", bomb)), (5, b"<</Type /Page /Contents 6 0 R>>"), (6, stream(b"", b"(plain) Tj")), kids=b"3 0 R 5 0 R")
    assert texts(raw) == ["", "plain"]


def test_malformed_bytes_never_raise():
    rng = random.Random(4)
    seeds = [compressed_file(), compressed_file(True), file_of(page(), (4, stream(b"", b"/F 1 Tf [(a) 2 <41>] TJ"))), b"", b"%PDF", b"1 0 obj <</Type /Pages /Kids 1 0 R>> endobj", b"1 0 obj 1 0 R endobj", b"<<" * 500, b"(" * 500]
    for raw in seeds:
        pdf.pages_of(raw)
        for _ in range(150):
            data = bytearray(raw)
            for _ in range(rng.randint(1, 6)):
                if data:
                    k = rng.randrange(len(data))
                    if rng.random() < 0.5:
                        data[k] = rng.randrange(256)
                    else:
                        del data[k : k + rng.randint(1, 30)]
            pdf.pages_of(bytes(data))


STATE = "doc string, page int, text string, unmapped boolean"
READ = "doc string, page int, ocr_text string, confidence double, failed boolean, fallback_text string, fallback_confidence double"


def test_page_states(spark):
    good, damaged = "a page with enough text", "\x01\x02\x03\x04\x05 broken layer text"
    found = spark.createDataFrame([("d", 1, good, False), ("d", 2, None, False), ("d", 3, "few", False), ("d", 4, damaged, False), ("d", 5, damaged, False), ("d", 6, "", False), ("d", 7, good, True), ("d", 8, "few", False), ("d", 9, "few", False), ("d", 10, "", False), ("d", 11, "few", False), ("e", 1, good, False), ("f", 1, "", False)], STATE)
    read = spark.createDataFrame([("d", 1, "unasked", 0.9, False, None, None), ("d", 3, "more of it", 0.9, False, None, None), ("d", 4, "clean", 0.8, False, None, None), ("d", 6, "unsure", 0.3, False, None, None), ("d", 7, "read anew", 0.9, False, None, None), ("d", 8, None, None, True, None, None), ("d", 9, " ", 0.9, False, None, None), ("d", 10, "poor", 0.3, False, "better", 0.95), ("d", 11, "kept", 0.7, False, " ", 0.1)], READ)
    states = pages.page_states(found, ["doc"], read, fallback_below=0.5)
    got = {(r.doc, r.page): (r.text, r.state, r.confidence) for r in states.collect()}
    assert got == {
        ("d", 1): (good, "text_layer", None), ("d", 2): ("", "needs_ocr_unmet", None), ("d", 3): ("few\nmore of it", "ocr_applied", 0.9), ("d", 4): ("clean", "ocr_applied", 0.8),
        ("d", 5): (damaged, "damaged_text_layer", None), ("d", 6): ("unsure", "ocr_low_confidence", 0.3), ("d", 7): ("read anew", "ocr_applied", 0.9), ("d", 8): ("few", "ocr_failed", None),
        ("d", 9): ("few", "needs_ocr_unmet", None), ("d", 10): ("better", "ocr_applied", 0.95), ("d", 11): ("few\nkept", "ocr_applied", 0.7), ("e", 1): (good, "text_layer", None), ("f", 1): ("", "needs_ocr_unmet", None),
    }
    docs = {r.doc: (r.status, r.pages, r.unmet_ocr_pages, r.missing_content_pages, r.low_confidence_pages) for r in pages.document_states(states, ["doc"]).collect()}
    assert docs == {"d": ("review", 11, 2, 1, 1), "e": ("ready", 1, 0, 0, 0), "f": ("failed", 1, 1, 0, 0)}
    assert [(r.doc, r.page) for r in pages.to_recognise(found, ["doc"], 3).orderBy("doc", "page").collect()] == [("d", 2), ("d", 3), ("d", 4), ("f", 1)]


def test_engines_and_their_fallback(spark):
    def first(image):
        if image == b"bad":
            raise OSError("no image")
        return image.decode(), 0.2 if image == b"unsure" else 0.9

    registries.ENGINES.register("first", first)
    registries.ENGINES.register("second", lambda image: (f"second {image.decode()}", 0.7))
    images = spark.createDataFrame([(1, bytearray(b"fine")), (2, bytearray(b"unsure")), (3, bytearray(b"bad")), (4, bytearray(b" ")), (5, None)], "id int, image binary")
    got = {r.id: (r.ocr_text, r.failed, r.fallback_text) for r in registries.recognised(images, ["id"], "image", "first", "second", 0.5).collect()}
    assert got == {1: ("fine", False, None), 2: ("unsure", False, "second unsure"), 3: (None, True, None), 4: (" ", False, "second  "), 5: ("", False, "second ")}
    blocks = {r.id: (r.status, r.issue) for r in registries.image_blocks(images, ["id"], "image", "first").collect()}
    assert blocks == {1: ("ready", None), 2: ("review", "ocr_low_confidence"), 3: ("review", "ocr_failed"), 4: ("review", "ocr_no_text"), 5: ("review", "ocr_no_text")}
    with pytest.raises(LookupError, match="unknown OCR engine"):
        registries.recognised(images, ["id"], "image", "nobody")


def test_table_rows_without_end_tags():
    table = [b for b in documents.html_blocks(b"<table><tr><th>h<th>i<tr><td>a<td>b<tr><td>c<td>d</table><p>after", documents.NEVER_SHOWN, tables=True) if b["block_type"] == "table"]
    assert table[0]["table_rows"] == [["h", "i"], ["a", "b"], ["c", "d"]]


def test_html_text_decodes_references(spark):
    frame = spark.createDataFrame([("<p>a &lt;b&gt; &quot;c&quot; &#233;&nbsp;&amp;amp;</p><script>x&lt;</script>",), (None,)], "h string")
    assert [r.t for r in frame.select(documents.html_text(F.col("h")).alias("t")).collect()] == ['a <b> "c" é &amp;', None]


def test_characters_outside_the_first_plane_are_pairs_of_codes():
    codes = pdf.Codes(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange")
    assert codes.text("a\U0001f600漢\U00020000".encode("utf-16-be")) == "a\U0001f600漢\U00020000"
    assert codes.text(b"\xd8\x3d\x00a\xde\x00") == "�a�"


def test_a_long_run_of_digits_is_scanned_once():
    import time

    raw = file_of(page(), (4, stream(b"", b"BT (" + b"7" * 60_000 + b") Tj ET")), table=False)
    began = time.time()
    assert texts(raw) == ["7" * 60_000] and time.time() - began < 2
