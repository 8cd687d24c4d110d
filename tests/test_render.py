"""One record of each family, with every field that its layout knows, against the text written out by hand."""

import pytest
from bibspark.plans import render
from pyspark.sql import functions as F

ALL = {
    "authors": ["Souza, Ana", "Bruno Lima"], "host_authors": ["Dias, C."], "composer": ["Villa, Heitor"], "creator": ["Lopes, Eva"], "performer": ["P One", "P Two."], "narrator": ["N"], "director": ["Dir"], "producer": ["Prod;"], "sound_responsibility": ["Mixed by M."], "audiovisual_responsibilities": ["Script: S."],
    "jurisdiction": ["BRASIL"], "entity_heading": ["Ministério"], "title": ["Title"], "subtitle": ["sub"], "part_title": ["Part"], "part_subtitle": ["psub"], "host_title": ["Host"], "host_subtitle": ["hsub"], "periodical_title": ["Period"], "newspaper_title": ["News"], "service_title": ["Service"],
    "event_name": ["EVENT"], "event_number": ["5."], "event_year": ["2019"], "event_place": ["Viana"], "event_document_title": ["Anais"], "event_pagination": ["100 p."], "event_notes": ["Note"], "place": ["Rio"], "publisher": ["Pub"], "publication_year": ["2020"], "publication_date": ["maio 2020"], "presentation_year": ["2018"], "defense_year": ["2018"],
    "start_year": ["1990"], "end_year": ["2000"], "consulted_period": ["v. 1-3"], "volume": ["7"], "issue": ["2"], "fascicle": ["3"], "year_designation": ["10"], "chapter": ["4"], "part_pages": ["1--9"], "article_pages": ["10–20"], "article_number": ["e1"], "publication_month": ["June"], "newspaper_date": ["1 jan. 2020"], "newspaper_section": ["Sec"], "newspaper_pages": ["5"],
    "edition": ["2. ed."], "other_responsibility": ["Trad. T"], "physical_description": ["50 p."], "illustrations": ["il."], "dimensions": ["20 cm"], "series": ["Series"], "notes": ["First note.", "Second"], "isbn": ["978-1"], "issn": ["1234-5678"], "support": ["1 CD"], "media_support": ["DVD"], "track": ["faixa 3"], "recording_label": ["Label"], "instrument": ["Piano"],
    "iconographic_support": ["1 foto"], "map_description": ["1 mapa"], "scale": ["1:100"], "manufacturer": ["Maker"], "software_version": ["v2"], "electronic_description": ["Site"], "advisor": ["Adv"], "pagination": ["120"], "work_type": ["Tese"], "degree_course": ["Doutorado"], "academic_affiliation": ["Univ"], "academic_place": ["Cidade"],
    "recipient": ["Rec"], "correspondence_date": ["2 fev. 1999"], "correspondence_description": ["1 carta"], "patent_number": ["BR 1"], "deposit_date": ["1 jan. 2001"], "grant_date": ["2 fev. 2002"], "patent_depositor": ["Dep"], "patent_holder": ["Hold"], "patent_attorney": ["Att"], "patent_classification": ["C1"],
    "legal_document_name": ["Lei"], "legal_document_number": ["10"], "legal_document_date": ["3 mar. 2003"], "ementa": ["Ementa"], "publication_source": ["Diário"], "court": ["STF"], "court_division": ["1. Turma"], "legal_document_type": ["Acórdão"], "process_number": ["99"], "judicial_unit": ["Vara"], "relator": ["Rel"], "judgment_date": ["4 abr. 2004"],
    "administrative_act_type": ["Portaria"], "administrative_act_number": ["7"], "signature_date": ["5 maio 2005"], "registry_office": ["Cartório"], "registry_document_type": ["Certidão"], "registry_date": ["6 jun. 2006"], "supplement_designation": ["Supl. 1"], "doi": ["10.1/x"], "url": ["https://e.org/a."], "access_date": ["2024-01-02"], "access_time": ["10h"],
}
WEB = "DOI: https://doi.org/10.1/x. Disponível em: https://e.org/a. Acesso em: 2 jan. 2024, 10h."
WHO = "SOUZA, Ana; LIMA, Bruno"
SERIAL = "ano 10, v. 7, n. 2, fasc. 3"
WANT = {
    "monograph": f"{WHO}. Title: sub. Trad. T. 2. ed. Rio: Pub, 2020b. 1 CD. 50 p. il. 20 cm. Series. First note. Second. ISBN 978-1. {WEB}",
    "academic_work": f"{WHO}. Title: sub. Orientador: Adv. 2018b. 120 f. Tese (Doutorado) – Univ, Cidade, 2018b. {WEB}",
    "monograph_part": f"{WHO}. Part: psub. In: DIAS, C. Host: hsub. Rio: Pub, 2020b. v. 7, cap. 4, p. 1-9. 1 CD. {WEB}",
    "correspondence": f"{WHO}. Title. Destinatário: Rec. Rio, 2 fev. 1999. 1 carta. First note. Second. 1 CD. {WEB}",
    "event_whole": f"EVENT, 5., 2019, Viana. Anais. Rio: Pub, 2020b. 100 p. Note. Supl. 1. ISBN 978-1. 1 CD. {WEB}",
    "event_whole_periodical": f"EVENT, 5., 2019, Viana. Anais. Period. Rio: Pub, {SERIAL}, maio 2020. 100 p. Note. Supl. 1. ISBN 978-1. 1 CD. {WEB}",
    "event_part": f"{WHO}. Part: psub. In: EVENT, 5., 2019, Viana. Anais. Rio: Pub, 2020b. p. 1-9. 1 CD. {WEB}",
    "event_part_periodical": f"{WHO}. Part: psub. Period, Rio, {SERIAL}, p. 1-9, maio 2020. Supl. 1. Trabalho apresentado no EVENT, 5., 2019, Viana. 1 CD. {WEB}",
    "patent": f"{WHO}. Title. Depositante: Dep. Titular: Hold. Procurador: Att. BR 1. Depósito: 1 jan. 2001. Concessão: 2 fev. 2002. C1. 1 CD. {WEB}",
    "legal_legislation": f"BRASIL. Lei n. 10, de 3 mar. 2003. Ementa. Diário. First note. Second. 1 CD. {WEB}",
    "legal_jurisprudence": f"BRASIL. STF (1. Turma). Acórdão 99. Ementa. Vara. Relator: Rel. 4 abr. 2004. Diário. 1 CD. {WEB}",
    "legal_administrative_act": f"BRASIL. Ministério. Portaria n. 7, de 5 maio 2005. Ementa. Diário. First note. Second. 1 CD. {WEB}",
    "civil_registry": "BRASIL. Cartório. Certidão. 6 jun. 2006. First note. Second.",
    "periodical_collection": f"Period. Rio: Pub, 1990b-2000. ISSN 1234-5678. First note. Second. 1 CD. {WEB}",
    "periodical_collection_part": f"Period. Rio: Pub, 1990b-2000. v. 1-3. ISSN 1234-5678. First note. Second. 1 CD. {WEB}",
    "periodical_issue": f"Period. Rio: Pub, {SERIAL}, maio 2020. Supl. 1. ISSN 1234-5678. First note. Second. 1 CD. {WEB}",
    "periodical_article": f"{WHO}. Title: sub. Period, Rio, {SERIAL}, p. 10-20, jun. 2020b. Supl. 1. First note. Second. 1 CD. {WEB}",
    "newspaper_article": f"{WHO}. Title: sub. News, Rio, {SERIAL}, 1 jan. 2020. Sec, p. 5. 1 CD. {WEB}",
    "audiovisual": f"Title. Direção: Dir. Produção: Prod. Script: S. Rio: Pub, 2020b. DVD. 50 p. First note. Second. 1 CD. {WEB}",
    "sound_document": f"{WHO}. Title. Mixed by M. Compositor: Villa, Heitor. Intérprete: P One; P Two. Ledor: N. Rio: Label, maio 2020. DVD. 50 p. First note. Second. 1 CD. {WEB}",
    "sound_document_part": "Part. Intérprete: P One; P Two. Compositor: Villa, Heitor. In: Host. Mixed by M. Rio: Label, 2020b. DVD, faixa 3. 50 p.",
    "score": f"VILLA, Heitor. Title: sub. Piano. Rio: Pub, 2020b. 50 p. First note. Second. 1 CD. {WEB}",
    "iconographic": f"{WHO}. Title. 2020b. 1 foto. 50 p. il. 20 cm. First note. Second. 1 CD. {WEB}",
    "cartographic": f"{WHO}. Title: sub. Rio: Pub, 2020b. 1 mapa. 50 p. il. 20 cm. Escala 1:100. First note. Second. 1 CD. {WEB}",
    "three_dimensional": "LOPES, Eva. Title. Rio: Maker, 2020b. 50 p. 20 cm. First note. Second.",
    "exclusive_electronic": f"{WHO}. Service. v2. Rio, 2020b. Site. First note. Second. {WEB}",
}


def record(spark, fields, family, medium="electronic", suffix="b"):
    return spark.createDataFrame([(fields, family, medium, True, suffix)], "fields map<string,array<string>>, family string, medium string, ready boolean, year_suffix string")


def rendered(spark, fields, family, medium="electronic", suffix="b", **options):
    return render.render(record(spark, fields, family, medium, suffix), families=[family], **options).first()["reference"]


def test_every_family_is_covered():
    assert set(WANT) == set(render.LAYOUTS)


@pytest.mark.parametrize("family", sorted(WANT))
def test_full_record(spark, family):
    assert rendered(spark, ALL, family) == WANT[family]


@pytest.mark.parametrize("family", sorted(WANT))
def test_bare_record_renders(spark, family):
    text = rendered(spark, {"title": ["T"]}, family, suffix="")
    assert text and "null" not in text and "  " not in text


def test_bare_article(spark):
    assert rendered(spark, {"title": ["T"], "periodical_title": ["P"], "article_number": ["e9"], "place": ["[S. L.]"]}, "periodical_article", suffix="") == "[AUTORIA NÃO IDENTIFICADA]. T. P, [s. l.], art. e9, [s. d.]."


def test_print_score_names_unknown_imprint(spark):
    assert rendered(spark, {"title": ["T"], "publication_year": ["1999"]}, "score", "print", "") == "[AUTORIA NÃO IDENTIFICADA]. T. [S. l.]: [s. n.], 1999."
    assert rendered(spark, {"title": ["T"], "publication_year": ["1999"]}, "score", "electronic", "") == "[AUTORIA NÃO IDENTIFICADA]. T. 1999."


def test_online_policy(spark):
    base = {"title": ["T"], "periodical_title": ["P"], "publication_year": ["1999"], "doi": ["https://doi.org/10.1/X."]}
    same = rendered(spark, base | {"url": ["http://dx.doi.org/10.1/x"]}, "periodical_article", suffix="")
    assert same.endswith("1999. DOI: https://doi.org/10.1/X.")
    other = rendered(spark, base | {"url": ["https://e.org"]}, "periodical_article", suffix="", access_date="2024-12-31")
    assert other.endswith("Disponível em: https://e.org. Acesso em: 31 dez. 2024.")
    strict = rendered(spark, base | {"url": ["https://e.org"]}, "periodical_article", suffix="", policy={"doi_url_deduplication": True, "distinct_url_with_doi": False})
    assert "Disponível" not in strict


def test_not_ready_has_no_reference(spark):
    rows = record(spark, ALL, "monograph").withColumn("ready", F.lit(False)).unionByName(record(spark, ALL, "unheard"))
    assert [r.reference for r in render.render(rows, families=["monograph"]).collect()] == [None, None]


def test_emphasis_and_keys(spark):
    row = record(spark, ALL, "legal_legislation", "print")
    got = row.select(render.emphasis(F.col("family"), F.col("medium"), F.col("fields")).alias("e")).first()["e"]
    assert got == ["Diário", "Lei"]
    view = render.Fields(F.col("fields"))
    keys = row.select(render.sort_responsibility(view).alias("n"), render.sort_title(view).alias("t"), render.year_value(view).alias("y"), render.authorship(view).alias("a")).first()
    assert (keys.n, keys.t, keys.y, keys.a) == (WHO, "Title", "2020", ["souza\tana", "lima\tbruno"])
    bare = record(spark, {"corporate_author": ["Brasil. X"]}, "monograph").select(render.sort_responsibility(view).alias("n"), render.year_value(view).alias("y"), render.authorship(view).alias("a")).first()
    assert (bare.n, bare.y, bare.a) == ("BRASIL. X", "s.d.", ["brasil. x\t"])
