import random
import struct

import encoders as enc
import fixtures as fx
import numpy as np
import pytest

from quire.formats import arithmetic, pixels
from quire.formats.errors import FormatError, Limits

#: The test sequence of T.88, Annex H.2, and its code; the code of T.81's QM test without stuffing.
PLAIN = bytes.fromhex("00020051000000C0035287 2AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF")
MQ_CODE = bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")
QM_PLAIN = bytes.fromhex("00020051000000C00352872AAAAAAAAA82C02000FCD79EF674EAABF7697EE74C")
QM_CODE = bytes.fromhex("655B5144F7969D517855BFFF00FC5184C7CEF93900287D46708ECBC0F6").replace(b"\xff\0", b"\xff")


def bits(data):
    return [b >> k & 1 for b in data for k in range(7, -1, -1)]


def picture(seed, width, height, repeats=True):
    r = random.Random(seed)
    rows = []
    for y in range(height):
        if repeats and y and r.random() < 0.3:
            rows.append(list(rows[-1]))
        else:
            rows.append([int(r.random() < (0.8 if (x // 5 + y // 3) % 2 else 0.1)) for x in range(width)])
    return rows


def test_standard_sequences():
    bit, bank = arithmetic.mq(MQ_CODE), [0]
    assert [bit(bank, 0) for _ in range(256)] == bits(PLAIN)
    bit, bank = arithmetic.qm(QM_CODE), [0]
    assert [bit(bank, 0) for _ in range(256)] == bits(QM_PLAIN)
    coder, bank = enc.MQ(), [0]
    for b in bits(PLAIN):
        coder.put(bank, 0, b)
    assert coder.finish() == MQ_CODE


@pytest.mark.parametrize("width,height", [(1, 1), (7, 3), (33, 20), (100, 40)])
def test_type0(width, height):
    rows = picture(width, width, height)
    got = pixels.type0(fx.bitmap(width, height) + enc.type0_body(rows))
    assert got.tolist() == rows
    assert len(pixels.packed(got)) == (width + 7) // 8 * height


def test_integers():
    values = [0, 3, -3, 4, 19, -20, 83, 84, 339, 340, -4435, 4436, 100_000, None, 1]
    coder = enc.MQ()
    numbers = enc.Numbers(coder)
    for v in values:
        numbers.put("IADW", v)
        numbers.symbol(5, 3)
    got = arithmetic.Integers(arithmetic.mq(coder.finish()))
    assert [(got.read("IADW"), got.symbol(3)) for _ in values] == [(v, 5) for v in values]


def page(width, height, *parts):
    info = struct.pack(">II", width, height) + bytes(11)
    kinds = [(1, 38, ())] if len(parts) == 1 else [(1, 0, ()), (2, 0, (1,)), (3, 6, (2,)), (4, 38, ())]
    return fx.bitmap(width, height) + fx.segment(0, 48, data=info) + b"".join(fx.segment(n, k, r, d) for (n, k, r), d in zip(kinds, parts, strict=True))


def test_generic():
    rows = picture(1, 41, 17)
    assert pixels.type3(page(41, 17, enc.generic_region(rows)))[0].tolist() == rows
    cut = page(41, 17, enc.generic_region(rows)[:-2])
    with pytest.raises(FormatError, match="final marker"):
        pixels.type3(cut)
    with pytest.raises(FormatError, match="generic region coding"):
        pixels.type3(page(41, 17, enc.generic_region(rows).replace(b"\x04\x02\xff", b"\x0c\x02\xff", 1)))


def symbols(flags=0x0010, items=((0, 0, 0), (3, 0, 0))):
    shapes = [picture(5, 4, 3, False), picture(6, 6, 3, False), picture(7, 5, 8, False)]
    new = [list(r) for r in shapes[2]]
    new[1][1] ^= 1
    new.append([1] * 5)
    parts = [enc.direct_dictionary(shapes), enc.refined_dictionary(shapes, new, 2, 0, 1), enc.text_region(40, 30, [(4, 2, items), (12, 1, items[:1])], flags), enc.generic_region([[0] * 40 for _ in range(30)])]
    return new, page(40, 30, *parts)


def test_symbols():
    new, data = symbols()
    want = np.zeros((30, 40), np.uint8)
    for x, y in ((2, 4), (2 + 4 + 3, 4), (3, 16)):
        want[y : y + 9, x : x + 5] |= np.array(new, np.uint8)
    got, anomaly = pixels.type3(data)
    assert (got == want).all() and anomaly is None
    # Bottom left corners in strips of two lines, with an offset between symbols of -1.
    new, data = symbols(0x0004 | 31 << 10, ((0, 1, 0), (3, 0, 0)))
    want[:] = 0
    for x, y in ((2, 9), (2 + 4 + 2, 8), (3, 33)):
        for i, j in np.argwhere(np.array(new)):
            if 0 <= y - 8 + i < 30:
                want[y - 8 + i, x + j] = 1
    assert (pixels.type3(data)[0] == want).all()
    with pytest.raises(FormatError, match="symbols limit exceeded"):
        pixels.type3(data, Limits(max_symbols=2))


def test_unused_template_is_told():
    _, data = symbols(0x8010)
    assert pixels.type3(data)[1] == "unused refinement template"
    with pytest.raises(FormatError, match="template without refinement"):
        pixels.type3(data, strict=True)


def test_empty_dictionaries():
    none = struct.pack(">H", 0x0800) + b"\x02\xff" + bytes(8) + b"\xff\xac"
    text = enc.region(40, 30) + struct.pack(">HI", 0x10, 0) + enc.MQ().finish()
    rows = picture(2, 40, 30)
    assert pixels.type3(page(40, 30, none, struct.pack(">H", 0x1802) + none[2:], text, enc.generic_region(rows)))[0].tolist() == rows


def test_bilevel_pages_become_pdf(spark):
    import zlib

    from quire.formats import pdf
    from quire.operators import documents

    first, second = picture(3, 20, 9), picture(4, 41, 17)
    images = [(0, fx.bitmap(20, 9) + enc.type0_body(first)), (3, page(41, 17, enc.generic_region(second)))]
    broken = fx.c8([fx.image_text((0, 0, 10, 10))], [(3, fx.bitmap(41, 17) + b"\0")])
    files = spark.createDataFrame([("a", bytearray(fx.c8([fx.image_text((0, 0, 100, 50), (10, 20, 30, 40)), b""], images))), ("b", bytearray(broken))], "path string, content binary")
    made = {r.path: r for r in documents.to_pdf(files).collect()}
    whole = pdf.Pdf(bytes(made["a"].pdf))
    assert made["a"].page_count == 2 and made["b"].error.kind == "Truncated"
    places = [at for _, at, _ in whole.rows.values() if b"/Subtype /Image" in whole.data[at : at + 80]]
    drawn = [whole._object_at(at) for at in places]
    assert [zlib.decompress(body) for _, body in drawn] == [np.packbits(np.array(x, np.uint8), axis=1).tobytes() for x in (first, second)]
    got = {(r.path, r.image): r for r in documents.decoded_images(files).collect()}
    assert [(got["a", k].width, got["a", k].height) for k in (1, 2)] == [(20, 9), (41, 17)] and got["b", 1].rows is None and got["b", 1].problem
