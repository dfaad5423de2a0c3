"""Line dedup of short lines and of lines without blanks."""

from softgrove.llm import line_dedup

CHINESE = "\u6211\u4eec\u4eca\u5929\u53bb\u56fe\u4e66\u9986\u770b\u4e66"


def test_short_lines_take_part(spark):
    rows = [(1, f"Home\n\n{CHINESE}\nabout us\n \t"), (2, f"{CHINESE}\nHOME\nother line\nx"), (3, "home\nx\nx"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["id"], r["line_no"]): (r["first"]["id"], r["first"]["line_no"], r["kept"])
           for r in line_dedup.line_groups(docs).collect()}
    assert got == {
        (1, 0): (1, 0, True), (1, 2): (1, 2, True), (1, 3): (1, 3, True),
        (2, 0): (1, 2, False), (2, 1): (1, 0, False), (2, 2): (2, 2, True), (2, 3): (2, 3, True),
        (3, 0): (1, 0, False), (3, 1): (2, 3, False), (3, 2): (2, 3, False)}
