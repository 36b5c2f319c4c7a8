"""Fixed schemas of the files this engine reads and writes."""

MANIFEST = "canonical_id string, absolute_image_path string"
COCO = (
    "categories array<struct<id:int,name:string>>, images array<struct<id:string,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:long,image_id:string,category_id:int,bbox:array<double>,score:double>>"
)
DETECTIONS = "canonical_id string, image_size_wh array<int>, detections array<struct<label:string,score:double,box_xyxy:array<double>>>, error string"
ACTIVITY = "Date string, Slug string, Usage double, Requests int, `Prompt Tokens` int, `Completion Tokens` int"
CATALOGUE = (
    "data array<struct<id:string,name:string,created:long,context_length:long,"
    "pricing:struct<prompt:string,completion:string,image:string>,architecture:struct<modality:string,tokenizer:string>,"
    "top_provider:struct<max_completion_tokens:long,is_moderated:boolean>>>"
)
ARCHIVE_PAGES = "archive string, member string, page_index int, size long, status string, content binary"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".tif", ".tiff")
