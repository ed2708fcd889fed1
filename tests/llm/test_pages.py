"""The alignment with the nearest pages decides on frames inside articles."""

from memoria.llm import html_extract


def texts(spark, bodies):
    df = spark.createDataFrame([(i, f"http://h.org/a/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    return [r.text.split("\n") for r in html_extract.extract(df).orderBy("page_id").collect()]


TOOLS = "<div class='tools-row'><p>Read this in our app</p><ul class=list><li>Save it</li></ul></div>"
OWN = ["one alpha", "two beta", "three gamma", "four delta", "five epsilon"]


def test_frames_that_the_nearest_pages_repeat_go(spark):
    page = lambda own: f"<article><h2>Summary</h2><p>{own}</p><p>{own} again</p><p>{own} and more</p>{TOOLS}<p>Quoted by all.</p><div class=body><p>{own} at last</p><p>Said by all.</p></div></article>"
    for own, found in zip(OWN, texts(spark, map(page, OWN)), strict=True):
        assert found == ["Summary", own, f"{own} again", f"{own} and more", "Quoted by all.", f"{own} at last", "Said by all."]


def test_frames_stay_without_two_pages_that_repeat_them(spark):
    page = lambda own, tools: f"<article><p>{own}</p><p>{own} again</p><p>{own} and more</p>{tools}</article>"
    whole = lambda own: [own, f"{own} again", f"{own} and more", "Read this in our app", "Save it"]
    # Two pages alone; frames of other names; frames without attributes; copies, which tell nothing.
    assert texts(spark, [page(own, TOOLS) for own in OWN[:2]]) == [whole(own) for own in OWN[:2]]
    named = [page(own, TOOLS.replace("tools-row", f"t{k}").replace("class=list", f"id=l{k}")) for k, own in enumerate(OWN)]
    assert texts(spark, named) == [whole(own) for own in OWN]
    assert texts(spark, [page(own, TOOLS.replace(" class='tools-row'", "").replace(" class=list", "")) for own in OWN]) == [whole(own) for own in OWN]
    assert texts(spark, [page(OWN[0], TOOLS)] * 4) == [whole(OWN[0])] * 4
