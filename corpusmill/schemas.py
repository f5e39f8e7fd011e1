"""Fixed schemas of the tables that readers make."""

ARTICLES = "pmcid string, article_url string, images array<string>"  # each image as JSON text, as some are no objects
IMAGE = "url string, caption string, label string"
FIGURES = "pmcid string, article_url string, url string, caption string, label string"
DOWNLOADS = "type string, ok boolean, pmcid string, url string, label string, image_path string, caption_path string"
INVENTORY = "path string, label string, pmcid string, filename_stem string"
PANELS = (
    "figure_id string, panel_id string, source_image string, x1 double, y1 double, x2 double, y2 double, "
    "crop_path string, width int, height int, aspect_ratio double, confidence double"
)
EMBEDDINGS = "id string, embedding array<float>"
CAPTION_PREDICTIONS = "panel_id string, figure_id string, reference string, prediction string"
VQA_PREDICTIONS = "panel_id string, figure_id string, question string, question_type string, reference string, prediction string"
