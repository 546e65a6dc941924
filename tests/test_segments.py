from tessella.operators import segments

# The score triples of each segment, and the further ones that VIP takes in classification.
GOLDEN = {
    "Champions": "555 554 545 455",
    "VIP": "535 525 515",
    "Loyal Customers": "444 445 454",
    "Potential Loyalists": "534 435",
    "Cannot Lose Them": "345 355 245 255",
    "At Risk": "224 225 234 235 324 325",
    "About to Sleep": "223 222 232 233",
    "New Customers": "543 542 533 532",
    "Promising": "523 524",
    "Need Attention": "422 432 433",
    "Lost": "111 112 121",
    "At Risk - Sleeping": "134 135 144 145",
    "Hibernating": "123 124 125 132 133",
}
VIP_TOO = "551 552 553"


def test_patterns_are_the_golden_ones():
    assert {n: " ".join(f"{r}{f}{m}" for r, f, m in p) for n, p in segments.PATTERNS.items()} == GOLDEN


def test_every_triple_has_its_golden_segment(spark):
    want = {t: n for n, triples in {**GOLDEN, "VIP": f"{GOLDEN['VIP']} {VIP_TOO}"}.items() for t in triples.split()}
    grid = spark.range(125).selectExpr("int(id / 25) + 1 AS r", "int(id / 5) % 5 + 1 AS f", "int(id % 5) + 1 AS m")
    got = grid.select("r", "f", "m", segments.segment13(*[grid[c] for c in "rfm"]).alias("segment")).collect()
    assert len(got) == 125
    for x in got:
        assert x.segment == want.get(f"{x.r}{x.f}{x.m}", segments.FALLBACK)
