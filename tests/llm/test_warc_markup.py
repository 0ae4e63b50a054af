"""Links in any quotes and references of any kind."""

from termloom.llm import warc


def test_links_and_references(spark):
    html = "<title>Caf&eacute; &#8217;x&#x27; &uuml;&#128512; &#128; &unknown; &amp;eacute; &#0;</title><a href='/one'>1</a><a class=x href=/two?a=1&amp;b=2>2</a><a href = \"/three\">3</a><A HREF= '/f\"our'>4</A><a href=\"/five\">5</a>"
    rows = warc.derive(warc.responses(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))).collect()
    meta = next(r.block for r in rows if r.record_type == "metadata")
    assert [x.split(": ", 1)[1] for x in meta.split("\r\n") if x.startswith("outlink")] == ["/one", "/two?a=1&b=2", "/three", '/f"our', "/five"]
    title = "Café ’x' ü😀 € &unknown; &eacute; �"
    assert f"title: {title}\r\n" in meta
    assert next(r.block for r in rows if r.record_type == "conversion").startswith(title)
