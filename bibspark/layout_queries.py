"""A query for each layout family that has no larger one of its own: suppliers as works of that family, with the SQL of their references.

Fields are Spark SQL expressions over n (the supplier's name) and k (its number); a null leaves the field out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.plans import render as layouts

ONLINE = " || 'Disponível em: https://x.org/' || CAST(k AS VARCHAR) || '. Acesso em: 5 mar. 2024.'"
EVENT = {"event_name": "'CONGRESSO'", "event_year": "'1999'", "event_place": "'Natal'"}
MADE = {"place": "'Natal'", "publisher": "'SBC'", "publication_year": "'2000'"}
ANA = {"authors": "'Ana Lima'"}
URL = {"url": "concat('https://x.org/', k)"}


def _even(text: str, other: str = "''") -> str:
    return f"CASE WHEN k % 2 = 0 THEN {text} ELSE {other} END"


#: family: (medium, fields, SQL of the reference).
WORKS: dict[str, tuple[str, dict[str, str], str]] = {
    "academic_work": (
        "print",
        ANA | {"title": "n", "subtitle": "if(k % 2 = 0, 'a study', null)", "advisor": "'Bruno Souza.'", "presentation_year": "'2010'", "pagination": "cast(k AS string)", "work_type": "'Tese'", "degree_course": "'Doutorado em Letras'", "academic_affiliation": "'Universidade X'", "academic_place": "'Lisboa'", "defense_year": "'2011'", "doi": "if(k % 3 = 0, concat('10.1/', k), null)"},
        f"'LIMA, Ana. ' || n || {_even("': a study'")} || '. Orientador: Bruno Souza. 2010. ' || CAST(k AS VARCHAR) || ' f. Tese (Doutorado em Letras) – Universidade X, Lisboa, 2011.' || CASE WHEN k % 3 = 0 THEN ' DOI: https://doi.org/10.1/' || CAST(k AS VARCHAR) || '.' ELSE '' END",
    ),
    "monograph_part": (
        "print",
        ANA | {"part_title": "n", "host_authors": "if(k % 2 = 0, 'Bruno Souza', null)", "host_title": "'Host'", "host_subtitle": "'whole'", "host_edition": "'2. ed.'", "place": "'Porto'", "publisher": "'Casa'", "publication_year": "'2000'", "volume": "if(k % 3 = 0, '3', null)", "chapter": "'4'", "part_pages": "'10--20'"},
        f"'LIMA, Ana. ' || n || '. In: ' || {_even("'SOUZA, Bruno. '")} || 'Host: whole. 2. ed. Porto: Casa, 2000. ' || CASE WHEN k % 3 = 0 THEN 'v. 3, ' ELSE '' END || 'cap. 4, p. 10-20.'",
    ),
    "correspondence": (
        "print",
        ANA | {"title": "n", "recipient": "'Carlos Melo'", "place": "if(k % 2 = 0, 'Roma', null)", "correspondence_date": "'1 maio 1950'", "correspondence_description": "'2 f.'", "notes": "'Original'"},
        f"'LIMA, Ana. ' || n || '. Destinatário: Carlos Melo. ' || {_even("'Roma, '")} || '1 maio 1950. 2 f. Original.'",
    ),
    "event_whole": (
        "print",
        EVENT | MADE | {"event_name": "upper(n)", "event_number": "if(k % 2 = 0, '5', null)", "event_document_title": "'Anais'", "event_pagination": "'300 p'", "event_notes": "'Resumos'", "isbn": "cast(k AS string)"},
        f"upper(n) || {_even("', 5.'")} || ', 1999, Natal. Anais. Natal: SBC, 2000. 300 p. Resumos. ISBN ' || CAST(k AS VARCHAR) || '.'",
    ),
    "event_whole_periodical": (
        "print",
        EVENT | {"event_document_title": "'Anais'", "periodical_title": "n", "place": "'Natal'", "publisher": "'SBC'", "volume": "if(k % 2 = 0, '7', null)", "publication_date": "'maio 2001.'", "supplement_designation": "'Suplemento'"},
        f"'CONGRESSO, 1999, Natal. Anais. ' || n || '. Natal: SBC' || {_even("', v. 7'")} || ', maio 2001. Suplemento.'",
    ),
    "event_part": (
        "electronic",
        ANA | EVENT | MADE | URL | {"part_title": "n", "event_document_title": "'Anais'", "part_pages": "if(k % 2 = 0, '5 – 9', null)"},
        f"'LIMA, Ana. ' || n || '. In: CONGRESSO, 1999, Natal. Anais. Natal: SBC, 2000. ' || {_even("'p. 5-9. '")}" + ONLINE,
    ),
    "event_part_periodical": (
        "print",
        ANA | EVENT | {"part_title": "n", "periodical_title": "'Revista'", "place": "if(k % 2 = 0, 'Natal', null)", "volume": "'2'", "issue": "'3'", "part_pages": "'4'", "publication_date": "'jun. 2002'"},
        f"'LIMA, Ana. ' || n || '. Revista, ' || {_even("'Natal'", "'[s. l.]'")} || ', v. 2, n. 3, p. 4, jun. 2002. Trabalho apresentado no CONGRESSO, 1999, Natal.'",
    ),
    "patent": (
        "print",
        ANA | {"title": "n", "patent_depositor": "'A', 'B'", "patent_holder": "if(k % 2 = 0, 'C', null)", "patent_number": "concat('BR ', k)", "deposit_date": "'1 jan. 2000'", "grant_date": "'2 fev. 2003'", "patent_classification": "'Int. Cl. A01'"},
        f"'LIMA, Ana. ' || n || '. Depositante: A; B. ' || {_even("'Titular: C. '")} || 'BR ' || CAST(k AS VARCHAR) || '. Depósito: 1 jan. 2000. Concessão: 2 fev. 2003. Int. Cl. A01.'",
    ),
    "legal_legislation": (
        "print",
        {"jurisdiction": "'BRASIL'", "legal_document_name": "'Lei'", "legal_document_number": "if(k % 2 = 0, cast(k AS string), null)", "legal_document_date": "'5 out. 1988'", "ementa": "n", "publication_source": "'Diário'"},
        f"'BRASIL. Lei' || {_even("' n. ' || CAST(k AS VARCHAR)")} || ', de 5 out. 1988. ' || n || '. Diário.'",
    ),
    "legal_jurisprudence": (
        "print",
        {"jurisdiction": "'BRASIL'", "court": "'Tribunal'", "court_division": "if(k % 2 = 0, '2. Turma', null)", "legal_document_type": "'Acórdão'", "process_number": "cast(k AS string)", "ementa": "n", "judicial_unit": "'Vara'", "relator": "'Bruno Souza'", "judgment_date": "'1 mar. 2001'", "publication_source": "'DJ'"},
        f"'BRASIL. Tribunal' || {_even("' (2. Turma)'")} || '. Acórdão ' || CAST(k AS VARCHAR) || '. ' || n || '. Vara. Relator: Bruno Souza. 1 mar. 2001. DJ.'",
    ),
    "legal_administrative_act": (
        "print",
        {"jurisdiction": "'BRASIL'", "entity_heading": "if(k % 2 = 0, 'Ministério', 'Brasil')", "administrative_act_type": "'Portaria'", "administrative_act_number": "cast(k AS string)", "signature_date": "'3 abr. 2002'", "ementa": "n", "publication_source": "'DOU'"},
        f"'BRASIL. ' || {_even("'Ministério. '")} || 'Portaria n. ' || CAST(k AS VARCHAR) || ', de 3 abr. 2002. ' || n || '. DOU.'",
    ),
    "civil_registry": ("print", {"jurisdiction": "'Recife'", "registry_office": "'Cartório 1'", "registry_document_type": "'Certidão'", "registry_date": "'1 jan. 1990'", "notes": "n"}, "'Recife. Cartório 1. Certidão. 1 jan. 1990. ' || n || '.'"),
    "periodical_collection": ("print", {"periodical_title": "n", "place": "'Natal'", "publisher": "'SBC'", "start_year": "'1990'", "end_year": "if(k % 2 = 0, '1999', null)", "issn": "'1234-5678'"}, f"n || '. Natal: SBC, 1990' || {_even("'-1999'")} || '. ISSN 1234-5678.'"),
    "periodical_collection_part": ("print", {"periodical_title": "n", "place": "'Natal'", "publisher": "'SBC'", "start_year": "'1990'", "consulted_period": "'1991-1992'"}, "n || '. Natal: SBC, 1990. 1991-1992.'"),
    "periodical_issue": (
        "print",
        {"periodical_title": "n", "periodical_subtitle": "if(k % 2 = 0, 'sub', null)", "place": "'Natal'", "publisher": "'SBC'", "volume": "'1'", "issue": "'2'", "publication_date": "'jan. 2000.'", "supplement_designation": "'Ed. especial'"},
        f"n || {_even("': sub'")} || '. Natal: SBC, v. 1, n. 2, jan. 2000. Ed. especial.'",
    ),
    "newspaper_article": (
        "print",
        ANA | {"title": "n", "newspaper_title": "'Jornal'", "place": "'Natal'", "newspaper_date": "'3 maio 2003'", "newspaper_section": "if(k % 2 = 0, 'Caderno A', null)", "newspaper_pages": "'4'"},
        f"'LIMA, Ana. ' || n || '. Jornal, Natal, ' || {_even("'3 maio 2003. Caderno A, p. 4.'", "'p. 4, 3 maio 2003.'")}",
    ),
    "audiovisual": ("print", {"title": "n", "director": "'Ana Lima', 'Bruno Souza'", "place": "if(k % 2 = 0, 'Rio', null)", "publisher": "'Filmes'", "publication_year": "'1980'", "media_support": "'1 DVD'"}, f"n || '. Direção: Ana Lima; Bruno Souza. ' || {_even("'Rio'", "'[S. l.]'")} || ': Filmes, 1980. 1 DVD.'"),
    "sound_document": (
        "print",
        {"authors": "if(k % 2 = 0, 'Ana Lima', null)", "title": "n", "sound_responsibility": "'Vários'", "composer": "'Ana Lima'", "place": "'Rio'", "recording_label": "'Selo'", "publication_year": "'1970'", "media_support": "'1 CD'"},
        f"{_even("'LIMA, Ana. '")} || n || '. Vários. Compositor: Ana Lima. Rio: Selo, 1970. 1 CD.'",
    ),
    "sound_document_part": (
        "print",
        {"part_title": "n", "host_title": "'Disco'", "performer": "'Ana Lima'", "place": "'Rio'", "recording_label": "'Selo'", "publication_year": "'1970'", "media_support": "'1 CD'", "track": "if(k % 2 = 0, 'faixa 3', null)"},
        f"n || '. Intérprete: Ana Lima. In: Disco. Rio: Selo, 1970. 1 CD' || {_even("', faixa 3'")} || '.'",
    ),
    "score": ("print", {"composer": "'Ana Lima'", "title": "n", "instrument": "if(k % 2 = 0, 'Piano', null)", "place": "'Rio'", "publisher": "'Casa'", "publication_year": "'1960'", "physical_description": "'1 partitura'"}, f"'LIMA, Ana. ' || n || '. ' || {_even("'Piano. '")} || 'Rio: Casa, 1960. 1 partitura.'"),
    "iconographic": ("print", ANA | {"title": "n", "publication_year": "'1950'", "iconographic_support": "'1 fotografia'", "dimensions": "if(k % 2 = 0, '10 x 15 cm', null)"}, f"'LIMA, Ana. ' || n || '. 1950. 1 fotografia.' || {_even("' 10 x 15 cm.'")}"),
    "cartographic": ("print", ANA | {"title": "n", "place": "'Rio'", "publisher": "'IBGE'", "publication_year": "'1940'", "map_description": "'1 mapa'", "scale": "concat('1:', k)"}, "'LIMA, Ana. ' || n || '. Rio: IBGE, 1940. 1 mapa. Escala 1:' || CAST(k AS VARCHAR) || '.'"),
    "three_dimensional": ("print", {"creator": "'ANA LIMA'", "title": "n", "manufacturer": "if(k % 2 = 0, 'Fábrica', null)", "place": "'Rio'", "publication_year": "'1930'", "physical_description": "'1 escultura'"}, f"'ANA LIMA. ' || n || '. ' || {_even("'Rio: Fábrica, '")} || '1930. 1 escultura.'"),
    "exclusive_electronic": (
        "electronic",
        URL | {"corporate_author": "'Empresa X.'", "service_title": "n", "software_version": "'v. 2'", "place": "if(k % 2 = 0, 'Rio', null)", "publication_year": "'2020'", "electronic_description": "'Site'"},
        f"'Empresa X. ' || n || '. v. 2. ' || {_even("'Rio, '")} || '2020. Site. '" + ONLINE,
    ),
}


def _query(family: str, medium: str, fields: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))
        given = ", ".join(f"struct('{name}' AS field, filter(array({value}), v -> v IS NOT NULL) AS v)" for name, value in fields.items())
        rows = rows.select("k", F.expr(f"map_from_entries(filter(array({given}), e -> size(e.v) > 0))").alias("fields"), F.lit(family).alias("family"), F.lit(medium).alias("medium"), F.lit(True).alias("ready"))
        return layouts.render(rows, access_date="2024-03-05", families=[family]).select(F.col("k").alias("s_suppkey"), "reference")

    run.__name__ = f"layout_{family}"
    run.__doc__ = f"Suppliers as works of the family {family}."
    return run


def register(query: Callable[[str], Callable]) -> None:
    for family, (medium, fields, sql) in WORKS.items():
        query(f"SELECT k AS s_suppkey, {sql} AS reference FROM (SELECT s_suppkey AS k, s_name AS n FROM supplier)")(_query(family, medium, fields))
