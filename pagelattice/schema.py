"""Schemas of nested records: one wide struct with a type tag stands for the union of block kinds."""

SIMPLE_BLOCK = "struct<type:string,value:string,display:boolean,url:string,alt:string,width:int,height:int,smiles:string>"
BLOCK = (
    "struct<type:string,value:string,display:boolean,url:string,alt:string,width:int,height:int,smiles:string,"
    f"rows:int,cols:int,cells:array<array<array<{SIMPLE_BLOCK}>>>>"
)
TABLE_STRUCTURE = (
    "struct<row_dividers:array<double>,col_dividers:array<double>,header_rows:int,cell_types:array<array<string>>,"
    "deskew_angle:double,source:string,finalized:boolean>"
)
LAYOUT_BLOCK = (
    "struct<id:string,label:string,bbox:array<int>,confidence:double,column_idx:int,reading_order:int,"
    f"table_structure:{TABLE_STRUCTURE},erase_regions:array<array<double>>>"
)
OCR_BLOCK = f"struct<block_id:string,label:string,bbox:array<int>,reading_order:int,column_idx:int,blocks:array<{BLOCK}>,duration_ms:double,error:string>"
NODE = (
    f"struct<id:string,type:string,source_block_ids:array<string>,content:array<{BLOCK}>,url:string,alt:string,width:int,height:int,"
    f"rows:int,cols:int,cells:array<array<array<{SIMPLE_BLOCK}>>>,label:string,message:string>"
)
FOLDER = "id string, name string, parent_id string, created_at timestamp, updated_at timestamp"
TAG = "id string, name string, color string"
DOCUMENT = (
    "id string, filename string, pdf_file string, thumbnail string, page_count int, status string, folder_id string, is_starred boolean, "
    "deleted_at timestamp, file_size bigint, file_type string, created_at timestamp, updated_at timestamp"
)
DOCUMENT_TAG = "document_id string, tag_id string"
PAGE = (
    "id string, document_id string, page_number int, session_id string, image_w int, image_h int, "
    f"layout_blocks array<{LAYOUT_BLOCK}>, ocr_blocks array<{OCR_BLOCK}>, placed_images string, status string, "
    "structured_content string, structure_status string"
)
ACTIVITY = "id bigint, document_id string, doc_label string, action string, created_at timestamp"
