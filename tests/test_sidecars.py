"""Settings in XML: what is read, what a merge keeps byte for byte, and a sink that commits all files or none."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import Row

from burstlake.sources import packets
from burstlake.sources.packets import CRS, RDF, SETTING

OWN, VENDOR = "urn:own", "urn:vendor"
PACKET = (
    '<?xpacket begin="﻿" id="W5"?>\n<!-- kept --><x:xmpmeta xmlns:x="adobe:ns:meta/" x:tk="a > b">\n <r:RDF xmlns:r="' + RDF + '">\n'
    '  <r:Description r:about=""\n    xmlns:c="' + CRS + '" xmlns:v=\'' + VENDOR + "'\n    c:Exposure2012 = '+0.50'   v:Secret='x &amp; \"y\" > z'\n    c:Contrast2012=\"5\">\n"
    '   <v:Note xmlns:w="urn:w" w:a="1">keep <w:b>this</w:b> &#233;</v:Note><!-- and this -->\n   <c:ToneCurvePV2012><r:Seq>\n<r:li>0, 0</r:li><r:li>255, 250</r:li></r:Seq></c:ToneCurvePV2012>\n'
    "   <c:Sharpness>40</c:Sharpness><c:Empty/>\n  </r:Description>\n  <r:Description r:about=\"\" xmlns:c='" + CRS + "' c:Exposure2012=\"9\"/>\n </r:RDF>\n</x:xmpmeta>\n<?xpacket end=\"w\"?>"
).encode()


def test_values():
    got = packets.values(PACKET)
    assert got[CRS, "Exposure2012"] == "+0.50" and got[VENDOR, "Secret"] == 'x & "y" > z' and got[CRS, "Sharpness"] == "40" and got[CRS, "Empty"] == ""
    assert got[CRS, "ToneCurvePV2012"] == ["0, 0", "255, 250"] and got[VENDOR, "Note"].startswith("keep") and len(got) == 7


def test_a_merge_touches_only_what_it_names():
    out = packets.merge(PACKET, {(CRS, "Exposure2012"): "1.25", (CRS, "Sharpness"): "10", (CRS, "Contrast2012"): None, (OWN, "Mode"): 'a "b" & <c>', (CRS, "ToneCurvePV2012"): ["0, 0", "9, 9"]})
    want = PACKET.replace(b"c:Exposure2012 = '+0.50'", b'c:Exposure2012 = "1.25"').replace(b'\n    c:Contrast2012="5">', b' c:Sharpness="10" xmlns:ns="urn:own" ns:Mode=\'a "b" &amp; &lt;c&gt;\'><c:ToneCurvePV2012><r:Seq><r:li>0, 0</r:li><r:li>9, 9</r:li></r:Seq></c:ToneCurvePV2012>')
    want = want.replace(b"<c:ToneCurvePV2012><r:Seq>\n<r:li>0, 0</r:li><r:li>255, 250</r:li></r:Seq></c:ToneCurvePV2012>", b"").replace(b"<c:Sharpness>40</c:Sharpness>", b"")
    assert out == want
    got = packets.values(out)
    assert got[CRS, "Exposure2012"] == "1.25" and got[CRS, "ToneCurvePV2012"] == ["0, 0", "9, 9"] and got[OWN, "Mode"] == 'a "b" & <c>' and (CRS, "Contrast2012") not in got
    assert packets.merge(PACKET, {}) == PACKET and packets.merge(out, {(OWN, "Mode"): 'a "b" & <c>'}) == out
    ET.fromstring(out)


def test_new_and_closed_and_default_namespaces():
    new = packets.merge(None, {(CRS, "Exposure2012"): "1", (CRS, "ToneCurvePV2012"): ["0, 0"]})
    assert packets.values(new) == {(CRS, "Exposure2012"): "1", (CRS, "ToneCurvePV2012"): ["0, 0"]}
    assert packets.values(packets.merge(new, {(CRS, "ToneCurvePV2012"): None, (CRS, "Exposure2012"): None})) == {}
    odd = f'<a xmlns="{RDF}"><Description crs="no" xmlns:crs="urn:not-it" crs:Exposure2012="keep"/></a>'.encode()
    out = packets.merge(odd, {(CRS, "Exposure2012"): "2"})
    assert packets.values(out) == {("", "crs"): "no", ("urn:not-it", "Exposure2012"): "keep", (CRS, "Exposure2012"): "2"}
    child = f'<r:RDF xmlns:r="{RDF}" xmlns:c="{CRS}"><r:Description><c:Exposure2012>1</c:Exposure2012>tail</r:Description></r:RDF>'.encode()
    assert packets.merge(child, {(CRS, "Exposure2012"): "3"}) == child.replace(b"<c:Exposure2012>1</c:Exposure2012>", b"").replace(b"<r:Description>", b'<r:Description c:Exposure2012="3">')


@pytest.mark.parametrize("body", [b"", b"<a>", b"<a/>", b"\xff\xfe<a/>", b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', PACKET[:-40], b"\x00\x01"])
def test_what_cannot_be_read_is_an_error(spark, body):
    with pytest.raises(ValueError):
        packets.merge(body, {(CRS, "Exposure2012"): "1"})
    df = spark.createDataFrame([(1, body, [(CRS, "Exposure2012", "1", None)]), (2, None, [(CRS, "Exposure2012", "1", None)])], "k int, p binary, s array<struct<namespace string, name string, value string, items array<string>>>")
    got = {r["k"]: r for r in packets.merged_packets(df, "k", "p", "s").collect()}
    assert got[1]["error"] and got[1]["packet"] is None and packets.values(bytes(got[2]["packet"])) == {(CRS, "Exposure2012"): "1"}
    assert [r["error"] is not None for r in packets.packet_values(df, "k", "p").collect()] == [True]


def setting(name, value=None, items=None, space=CRS):
    return Row(namespace=space, name=name, value=value, items=items)


def rows(spark, settings, parts):
    return spark.createDataFrame(list(settings.items()), "sidecar string, settings " + SETTING.simpleString().join(["array<", ">"])).repartition(parts, "sidecar")


def test_the_sink_commits_all_files_or_none(spark, tmp_path):
    packets.register_sink(spark)
    names = [f"p{i}.xmp" for i in range(12)]
    (tmp_path / names[0]).write_bytes(PACKET)
    (tmp_path / names[1]).write_bytes(b"<broken")
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    save = lambda df, **o: df.write.format("sidecars").options(**o).mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="element|broken|well-formed|token"):
        save(rows(spark, {n: [setting("Exposure2012", "2")] for n in names}, 6))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == before
    good = [n for n in names if n != names[1]]
    save(rows(spark, {n: [setting("Exposure2012", "2"), setting("Mode", "on", space=OWN)] for n in good}, 6))
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(names)
    assert (tmp_path / names[0]).read_bytes() == packets.merge(PACKET, {(CRS, "Exposure2012"): "2", (OWN, "Mode"): "on"})
    assert all(packets.values((tmp_path / n).read_bytes())[CRS, "Exposure2012"] == "2" for n in good)
    save(rows(spark, {n: [setting("Exposure2012", "7")] for n in [*good, "new.xmp"]}, 3), createOnly="true")
    assert packets.values((tmp_path / names[2]).read_bytes())[CRS, "Exposure2012"] == "2" and packets.values((tmp_path / "new.xmp").read_bytes())[CRS, "Exposure2012"] == "7"
