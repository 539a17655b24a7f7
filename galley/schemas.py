"""Fixed schemas of the records. Unknown keys of a source record travel in ``extras``, as JSON text."""

from __future__ import annotations

LANG = "struct<RUS:string,ENG:string>"
LANGS = "struct<RUS:array<string>,ENG:array<string>>"
CODES = "struct<spin:string,orcid:string,scopusid:string,researcherid:string>"
INFO = (
    "struct<surname:string,initials:string,orgName:string,address:string,email:string,otherInfo:string,"
    f"authorCodes:{CODES}>"
)
AUTHORS = f"array<struct<num:string,correspondence:boolean,individInfo:struct<RUS:{INFO},ENG:{INFO}>>>"
ARTICLE_CODES = "struct<udk:string,bbk:string,doi:string,edn:string>"
DATES = "struct<dateReceived:string,dateAccepted:string,datePublication:string>"

# Body of one article record as it is stored.
ARTICLE_FIELDS = {
    "pages": "string",
    "artType": "string",
    "PublLang": "string",
    "authors": AUTHORS,
    "artTitles": LANG,
    "abstracts": LANG,
    "codes": ARTICLE_CODES,
    "keywords": LANGS,
    "references": LANGS,
    "dates": DATES,
    "fundings": LANG,
    "shortMessage": LANG,
    "file": "string",
    "article_url": "string",
    "pdf_url": "string",
    "processed": "boolean",
    "extras": "string",
}
ARTICLE_DDL = ", ".join(f"`{k}` {v}" for k, v in ARTICLE_FIELDS.items())
ARTICLE_KEYS = ["issue", "name"]

# The flat form, in its order.
FORM_FIELDS = [
    "title", "title_en", "doi", "annotation", "annotation_en", "keywords", "keywords_en", "references_ru",
    "references_en", "year", "issue", "article_number", "url", "url_en", "pages", "udc", "received_date",
    "reviewed_date", "accepted_date", "funding",
]
FORM_LISTS = ["references_ru", "references_en"]

LINES_DDL = "doc_id bigint, page int, line_no int, text string"
JOURNALS_DDL = "ISSN string, ISSN_Print string, ISSN_Online string, Title string, TitleEn string, Url string, RAS string"
