"""The schemas of the public manual of references that the layouts follow, as one small table and three rules.

Schema ids are a prefix and the manual's number; the prefix is a parameter, as stored records may have another.
"""

from __future__ import annotations

from bibspark.plans.catalog import Catalog

# The fields, in the order in which they stand in a reference's description; a star marks those that hold a list.
FIELDS = """
authors* corporate_author jurisdiction entity_heading event_name event_number event_year event_place title subtitle edition version other_responsibility place publisher publication_year
publication_date start_year end_year physical_description illustrations dimensions series notes* isbn issn doi url access_date access_time support advisor presentation_year pagination work_type
degree_course academic_affiliation academic_place defense_year part_title part_subtitle host_authors* host_title host_subtitle host_edition volume chapter part_pages recipient correspondence_date
correspondence_description event_document_title event_pagination event_notes* periodical_title periodical_subtitle year_designation issue fascicle article_pages article_number publication_month
publication_period supplement_designation consulted_period newspaper_title newspaper_subtitle newspaper_date newspaper_section newspaper_pages patent_depositor* patent_holder* patent_attorney*
patent_number deposit_date grant_date patent_classification legal_document_name legal_document_number legal_document_date ementa publication_source court court_division legal_document_type
process_number judicial_unit relator judgment_date administrative_act_type administrative_act_number signature_date registry_office registry_document_type registry_date director* producer*
audiovisual_responsibilities* media_support sound_responsibility* composer* performer* narrator* recording_label track instrument iconographic_support scale map_description creator* manufacturer
electronic_description service_title software_version
"""

# Number, family and medium of each schema, the fields that it requires, and after the semicolon those that it may have.
SCHEMAS = """
1 monograph print: title place publisher publication_year; authors corporate_author subtitle edition other_responsibility physical_description illustrations dimensions series notes isbn
2 academic_work print: authors title presentation_year work_type degree_course academic_affiliation academic_place defense_year; subtitle advisor pagination doi url access_date
3 monograph electronic: title place publisher publication_year; authors corporate_author subtitle edition support physical_description series isbn doi url access_date access_time
4 monograph_part print: authors part_title host_authors host_title place publisher publication_year part_pages; part_subtitle host_subtitle host_edition volume chapter
5 monograph_part electronic: authors part_title host_title place publisher publication_year; part_subtitle host_authors host_subtitle host_edition volume chapter part_pages support doi url access_date access_time
6 correspondence print: authors title correspondence_date correspondence_description; recipient place notes
7 correspondence electronic: authors title correspondence_date correspondence_description; recipient place support url access_date access_time
8 event_whole print: event_name event_year event_place event_document_title place publisher publication_year; event_number event_pagination event_notes isbn
9 event_whole_periodical print: event_name event_year event_place event_document_title periodical_title place publisher publication_date; event_number volume issue fascicle supplement_designation event_notes
10 event_whole electronic: event_name event_year event_place event_document_title place publisher publication_year; event_number doi support url access_date access_time
11 event_part print: authors part_title event_name event_year event_place event_document_title place publisher publication_year part_pages; part_subtitle event_number
12 event_part_periodical print: authors part_title periodical_title place publication_date event_name event_year event_place; part_subtitle year_designation volume issue fascicle part_pages event_number supplement_designation
13 event_part electronic: authors part_title event_name event_year event_place event_document_title place publisher publication_year; part_subtitle event_number part_pages support doi url access_date access_time
14 patent print: authors title patent_number deposit_date; patent_depositor patent_holder patent_attorney grant_date patent_classification
15 patent electronic: authors title patent_number deposit_date; patent_depositor patent_holder patent_attorney grant_date patent_classification support url access_date access_time
16_1 legal_legislation print: jurisdiction legal_document_name legal_document_date ementa publication_source; legal_document_number notes
16_2 legal_legislation electronic: jurisdiction legal_document_name legal_document_date ementa; legal_document_number publication_source support url access_date access_time notes
16_3 legal_jurisprudence print: jurisdiction court legal_document_type publication_source; court_division process_number ementa judicial_unit relator judgment_date notes
16_4 legal_jurisprudence electronic: jurisdiction court legal_document_type; court_division process_number ementa judicial_unit relator judgment_date publication_source support url access_date access_time
16_5 legal_administrative_act print: jurisdiction administrative_act_type signature_date ementa publication_source; entity_heading administrative_act_number notes
16_6 legal_administrative_act electronic: jurisdiction administrative_act_type signature_date ementa; entity_heading administrative_act_number publication_source support url access_date access_time notes
16_7 civil_registry print: jurisdiction registry_office registry_document_type registry_date; notes
17 periodical_collection print: periodical_title place publisher start_year; periodical_subtitle end_year issn notes
18 periodical_collection electronic: periodical_title place publisher start_year; periodical_subtitle end_year issn doi support url access_date access_time notes
19 periodical_collection_part print: periodical_title place publisher start_year consulted_period; periodical_subtitle end_year issn
20 periodical_issue print: periodical_title place publisher publication_date; periodical_subtitle year_designation volume issue fascicle publication_period supplement_designation
21 periodical_article print: authors title periodical_title place publication_year; subtitle periodical_subtitle year_designation volume issue fascicle article_pages article_number publication_month publication_period supplement_designation notes
22 periodical_article electronic: authors title periodical_title publication_year; subtitle periodical_subtitle place year_designation volume issue fascicle article_pages article_number publication_month publication_period supplement_designation doi support url access_date access_time notes
23 newspaper_article print: authors title newspaper_title place newspaper_date; subtitle newspaper_subtitle year_designation volume issue newspaper_section newspaper_pages doi
24 newspaper_article electronic: authors title newspaper_title place newspaper_date; subtitle newspaper_subtitle year_designation volume issue newspaper_section newspaper_pages doi support url access_date access_time
25_1 audiovisual print: title publication_year media_support; director producer place publisher audiovisual_responsibilities physical_description notes
25_2 audiovisual electronic: title publication_year media_support; director producer place publisher audiovisual_responsibilities physical_description support url access_date access_time notes
26 sound_document print: title sound_responsibility publication_year media_support; authors composer performer narrator place recording_label physical_description notes
26_1 sound_document_part print: part_title host_title publication_year media_support track; performer composer sound_responsibility place recording_label physical_description
26_2 sound_document electronic: title sound_responsibility publication_date media_support; authors composer performer narrator place recording_label physical_description support url access_date access_time notes
27 score print: composer title place publisher publication_year physical_description; subtitle instrument notes
28 score electronic: composer title publication_year physical_description; subtitle instrument place publisher support url access_date access_time notes
29 iconographic print: authors title publication_year iconographic_support; physical_description illustrations dimensions notes
30 iconographic electronic: authors title publication_year iconographic_support; physical_description illustrations dimensions support url access_date access_time notes
31 cartographic print: authors title place publisher publication_year map_description; subtitle scale physical_description illustrations dimensions notes
32 cartographic electronic: authors title place publisher publication_year map_description; subtitle scale physical_description illustrations dimensions support url access_date access_time notes
33 three_dimensional print: creator title publication_year physical_description; place manufacturer dimensions notes
34 exclusive_electronic electronic: corporate_author service_title publication_year electronic_description; authors software_version place support url access_date access_time notes
"""

AUTHORED = {"any_of": ["authors", "corporate_author"]}
REACHABLE = {"any_of": ["support", "url"]}
DATED = {"when_field_present": "url", "then_required": ["access_date"]}
SINGLE = ("exclusive_electronic",)  # needs no support beside what it describes


def _conditions(number: str, family: str, medium: str, named: list[str]) -> list[dict]:
    """What must hold beyond required fields: electronic works name an author, a support or address, and with an address a date of access."""
    if medium == "electronic":
        return [AUTHORED, *[REACHABLE] * (family not in SINGLE), DATED]
    return [AUTHORED] * (family == "monograph") + [DATED] * ("url" in named)


def payload(prefix: str = "manual") -> dict:
    """The catalog as `Catalog.load` takes it."""
    fields = [{"id": f.rstrip("*"), "repeatable": f.endswith("*"), "value_type": "text_list" if f.endswith("*") else "text"} for f in FIELDS.split()]
    order = {f["id"]: i for i, f in enumerate(fields)}
    schemas = []
    for line in SCHEMAS.strip().splitlines():
        head, _, body = line.partition(": ")
        number, family, medium = head.split()
        required, conditional = (part.split() for part in body.split(";"))
        named = sorted(required + conditional, key=order.__getitem__)
        schemas.append({"id": f"{prefix}.{number}", "section": number, "family": family, "medium": medium, "required_fields": required, "conditional_fields": conditional, "ordered_fields": named, "conditions": _conditions(number, family, medium, named)})
    return {"fields": fields, "schemas": schemas, "output_policy": {"network_access": False, "doi_url_deduplication": True, "distinct_url_with_doi": True}}


def catalog(prefix: str = "manual") -> Catalog:
    return Catalog.load(payload(prefix))
