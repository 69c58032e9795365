"""Data model: Spark types of pages, boxes, lines and blocks, and the options that define behaviour."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

BOX = "struct<x:double,y:double,w:double,h:double>"
LINE = f"struct<text:string,box:{BOX}>"
PAGE = "extraction_id bigint, document_id string, page_id string, page_no int, pdf_w_pt double, pdf_h_pt double, img_w int, img_h int"
DETECTION = f"extraction_id bigint, page_no int, det_idx int, label string, class_idx int, confidence double, box {BOX}"
BLOCK = f"extraction_id bigint, page_no int, block_idx int, label string, confidence double, box {BOX}, lines array<{LINE}>"
PAGE_KEY = ["extraction_id", "page_no"]

#: Class labels in model order.
LABELS = ("Caption", "Footnote", "Formula", "List", "Page Footer", "Page Header", "Figure", "Section Header", "Table", "Text", "Title")
#: Labels read as one piece.
ATOMIC = ("title", "section header", "caption", "page header", "page footer")
#: Accepted file types.
IMAGE_TYPES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")


# The names of the modes and the defaults of the options below define behaviour.


class WordSegmentation(Enum):
    NONE = "None"
    WORD = "WordLevelOcr"
    PROPORTIONAL = "Proportional"
    WINDOW = "Window"


@dataclass(frozen=True)
class LayoutOptions:
    side: int = 640
    min_confidence: float = 0.25
    max_iou: float = 0.45
    max_aspect: float = 3.0


@dataclass(frozen=True)
class CascadeOptions:
    gate: float = 0.75
    min_overlap: float = 0.5
    strong_words: int = 50
    max_control: float = 0.05
    max_word_iou: float = 0.3
    max_chars: int | None = None  # a page with more characters among its first words is no strong text


@dataclass(frozen=True)
class OcrOptions:
    segmentation: WordSegmentation = WordSegmentation.NONE
    cluster: bool = False
    batch: int = 32
    line_height: int = 48
    window: int = 600
    min_gap: int = 10  # columns without ink that part words of a window
    pad: int = 4  # columns kept on either side of a window
    min_ink: float = 0.0
    top_pad: int = 4
    median_ratio: float = 0.5


@dataclass(frozen=True)
class PreprocessOptions:
    enabled: bool = False
    deskew: bool = True
    min_height: int = 60
    max_angle: float = 5.0
    step: float = 0.5
    binarize: bool = True
    block: int = 31
    c: float = 10.0
    upscale_under: int = 32
    upscale_to: int = 64
