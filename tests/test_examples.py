from rasterflow.plans import examples


def test_bits(spark):
    assert examples.wrong_bytes(spark, 1000) == 0
    raw = bytes(r.b for r in examples.bit_pattern(spark, 13).orderBy("byte_idx").collect())
    bits = examples.BITS * 13 + "0" * 6
    assert raw == int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_huffman(spark):
    drawn, coded, again = examples.round_trip(spark, b"abracadabra" * 9)
    assert again == b"abracadabra" * 9 and len(coded) < 99 // 3 and drawn.startswith("* (99)") and "97 (45)" in drawn
