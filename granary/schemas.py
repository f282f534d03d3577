"""Explicit schemas; no file is read with an inferred one."""

SECTION = "struct<heading:string,content:string>"
PAGE = (
    "url string, type string, title string, h1 string, meta_description string, breadcrumbs array<string>, content string, "
    f"sections array<{SECTION}>, last_crawled string, course_code string, program_code string, level string, uoc string, "
    "faculty string, school string, offering_terms string, duration string"
)
METADATA = "struct<url:string,title:string,section_heading:string,breadcrumbs:string,chunk_index:int,content_type:string>"
CHUNK = f"id string, text string, metadata {METADATA}"
VECTOR = f"{CHUNK}, embedding array<double>"
ANSWER = "answer string, sources array<struct<url:string,title:string>>, chunks_used int, response_time_ms int"
