"""Export files by byte ranges against the same files read whole."""

import pytest

from folioscope.sources import exports


def bibtex(n):
    return [f'@article{{k{i},\n title = {{Title {i} {{Nested}}}},\n doi = {{10.5/{i}}}, year = "{2000 + i % 20}",\n author = {{One, A and\n Two, B}}, journal = {{J {i % 3}}}}}' + ("@comment{no, title={Not}}" if i % 5 == 0 else "") for i in range(n)]


def ris(n):
    return [f"TY  - JOUR\nT1  - Title {i}\n  goes on\nDO  - 10.5/{i}\nPY  - {2000 + i % 20}\nAU  - One, A\nKW  - k{i}\n{'ER  - ' if i % 4 else 'ER - '}" for i in range(n)]


def medline(n):
    return [f"PMID- {7000 + i}\nTI  - Title {i % 50}\n      that goes on\nAID - 10.5/{i} [doi]\nDP  - {2000 + i % 20} May\n{' ' if i % 7 == 0 else ''}" for i in range(n)]


MAKE = {"bibtex": (bibtex, ".bib"), "ris": (ris, ".ris"), "medline": (medline, ".nbib")}


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("kind", list(MAKE))
def test_ranges_give_the_records_of_whole_files(spark, tmp_path, small_ranges, kind):
    make, ext = MAKE[kind]
    records = make(400)
    between = "\n\n" if kind == "medline" else "\n"
    files = {
        "unix": between.join(records), "dos": between.join(records).replace("\n", "\r\n"), "mac": between.join(records[:20]).replace("\n", "\r"), "mark": "﻿" + between.join(records), "junk": "% exported\nby hand\n\n" + between.join(records) + "\n\n\n\n",
        "mixed": between.join(records[:200]) + between + between.join(records[200:]).replace("\n", "\r\n"), "one": records[1], "é name %41": between.join(records[:9]), "none": "", "tight": between.join(records[:40]).replace("\n\nPMID- 7009", "\nPMID- 7009").replace("\n\n\nPMID- 7011", "\nPMID- 7011"), "at": between.join(records[:30]).replace("goes on", "\n@ 5").replace("Two, B", "Two,\n@ 5, B"),
    }
    for name, text in files.items():
        (tmp_path / f"{name}{ext}").write_bytes(text.encode())
    parse = {"bibtex": exports.bibtex_records, "ris": exports.ris_records, "medline": exports.medline_records}[kind]
    rows = lambda d: sorted(tuple(map(str, r)) for r in d.collect())
    split, whole = exports.read(spark, str(tmp_path), kind), parse(exports._texts(spark, str(tmp_path)))
    assert rows(split) == rows(whole)
    assert len(rows(whole)) > 1900
    assert exports.record_texts(spark, str(tmp_path / f"unix{ext}"), kind).rdd.getNumPartitions() >= 8


def test_last_record_of_a_title_wins_over_ranges(spark, tmp_path, small_ranges):
    (tmp_path / "a.nbib").write_text("\n\n".join(medline(400)))
    (tmp_path / "b.nbib").write_text("\n\n".join(medline(60)))
    found = {r["key"]: r["pmid"] for r in exports.medline_ids(exports.record_texts(spark, str(tmp_path), "medline")).collect()}
    assert found == {f"title {i} that goes on": str(7000 + (i + 50 if i < 10 else i)) for i in range(50)}


def test_a_folder_of_mixed_exports(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bib").write_text("\n".join(bibtex(3)))
    (tmp_path / "sub" / "b.ris").write_text("\n".join(ris(4)))
    (tmp_path / "c.txt").write_text("\n\n".join(medline(5)))
    (tmp_path / "odd.txt").write_text("OWN - x\nTI  - Odd\n")
    (tmp_path / "d.txt").write_text("TI\tAB\tDI\tPY\tSO\tTC\tAU\tDE\tSC\nT1\ta\t10.2/w\t2021\tJ\t4\tX\tk\tc\n")
    (tmp_path / "e.csv").write_text("Title,Abstract,DOI,Year,Source title,Cited by,Authors\nS,a,10.1/Q,2020,Rev,3,A; B\n")
    (tmp_path / "f.csv").write_text("PMID,Title,Authors,Journal/Book,Publication Year,DOI\n1,P,A,J,2019,10.9/p\n")
    (tmp_path / "A-Great-Paper_2023_x.pdf").write_bytes(b"%PDF")
    (tmp_path / "g.xyz").write_text("nothing")
    counts = {r["source_file"]: r["count"] for r in exports.read_all(spark, str(tmp_path)).groupBy("source_file").count().collect()}
    assert counts == {"a.bib": 3, "b.ris": 4, "c.txt": 5, "odd.txt": 1, "d.txt": 1, "e.csv": 1, "f.csv": 1, "A-Great-Paper_2023_x.pdf": 1}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.xyz").write_text("nothing")
    assert exports.read_all(spark, str(tmp_path / "empty")).collect() == []
