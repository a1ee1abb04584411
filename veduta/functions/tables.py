"""Fixed dimension data: formats, extension and media-type tables."""

from __future__ import annotations

#: Formats by kind, tier, renderer and whether a cheap path exists.
FORMATS = [
    ("image", 1, "image_crate", True, "png gif webp bmp tiff ico"),
    ("image", 2, "libav", True, "jpeg"),
    ("vector", 2, "resvg", False, "svg"),
    ("image", 2, "jxl_oxide", False, "jxl"),
    ("image", 2, "libav", False, "hdr heic psd pbm tga"),
    ("image", 2, "raw_preview", True, "dng cr2 nef arw orf rw2 pef srw raf 3fr fff iiq mef rwl raw"),
    ("video", 2, "libav", False, "mp4 mov avi webm mkv flv ts 3gp ogv wmv mpeg m2ts mxf av1"),
    ("audio", 2, "libav", True, "mp3"),
    ("audio", 2, "libav", False, "wav flac ogg m4a aac wma aiff opus"),
    ("document", 2, "builtin", True, "odt ods odp docx xlsx pptx"),
    ("document", 3, "pdftoppm", False, "pdf"),
    ("image", 3, "ffmpeg_cli", False, "jpeg png webp bmp tiff psd gif jp2 pcx qoi xbm xpm xwd pam avif heic"),
    ("vector", 3, "ffmpeg_cli", False, "svg"),
    ("image", 3, "oiiotool", False, "exr hdr dpx cin dds dcm fits iff pic rla sgi zfile"),
    ("geometry", 3, "f3d", False, "glb gltf fbx dae dxf off exo 3ds gml ply pts stl obj vrml vtk vtu vtp vti vtr vts vtm step iges brep"),
    ("geometry", 3, "usdz", False, "usdz usd"),
]
#: Other spellings of an extension.
ALIASES = {
    "jpeg": "jpg jpe",
    "tiff": "tif",
    "jp2": "j2k",
    "exr": "sxr mxr",
    "hdr": "rgbe",
    "sgi": "rgb rgba int inta",
    "pbm": "pgm ppm pfm",
    "heic": "heics heif",
    "mpeg": "mpg mpe",
    "mp4": "m4v",
    "m4a": "m4b",
    "midi": "mid",
    "aiff": "aifc",
    "docx": "doc",
    "xlsx": "xls xlsm",
    "pptx": "ppt",
    "svg": "svgz",
    "vrml": "wrl",
    "step": "stp stpnc p21 210",
    "iges": "igs",
    "exo": "ex2 e",
    "usd": "usda usdc",
    "cr2": "crw",
    "html": "htm",
}
#: Extensions by kind, kinds in rank order.
KINDS = {
    "image": "jpeg png gif webp bmp tiff avif heic exr hdr apng ico xcf jxl psd pbm tga jp2 sgi dpx cin dds fits iff pic rla zfile dng cr2 nef arw orf rw2 pef srw 3fr mef rwl raf fff iiq raw",
    "vector": "svg emf wmf",
    "video": "mp4 mov mkv avi webm mpeg ogv flv ts 3gp wmv m2ts mxf av1",
    "audio": "mp3 ogg flac wav m4a aac midi opus oga weba wma aiff",
    "document": "pdf docx xlsx pptx odt doc xls ppt odp ods epub rtf html xhtml",
    "geometry": "usdz usd glb gltf obj stl fbx dae dxf off 3ds gml ply pts vrml vtk vtu vtp vti vtr vts vtm step iges brep exo",
    "archive": "zip tar gz bz2 xz rar 7z",
    "text": "xml json txt csv md",
}
#: Media type of an extension.
MIME_OF = """
jpeg image/jpeg; png image/png; gif image/gif; webp image/webp; bmp image/bmp; tiff image/tiff; avif image/avif; heic image/heic;
exr image/x-exr; hdr image/vnd.radiance; jxl image/jxl; psd image/vnd.adobe.photoshop; jp2 image/jp2; pbm image/x-portable-bitmap;
tga image/x-tga; xcf image/x-xcf; sgi image/x-sgi; dpx image/x-dpx; cin image/x-cineon; dds image/vnd-ms.dds; fits image/fits;
iff image/x-iff; dng image/x-adobe-dng; cr2 image/x-canon-cr2; nef image/x-nikon-nef; arw image/x-sony-arw; orf image/x-olympus-orf;
rw2 image/x-panasonic-rw2; pef image/x-pentax-pef; srw image/x-samsung-srw; 3fr image/x-hasselblad-3fr; mef image/x-mamiya-mef;
rwl image/x-leica-rwl; raf image/x-fuji-raf; fff image/x-hasselblad-fff; iiq image/x-phaseone-iiq; raw image/x-raw; svg image/svg+xml;
emf image/emf; wmf image/wmf; apng image/apng; ico image/vnd.microsoft.icon; mp4 video/mp4; mov video/quicktime; mkv video/x-matroska;
avi video/x-msvideo; webm video/webm; mpeg video/mpeg; ogv video/ogg; flv video/x-flv; ts video/mp2t; 3gp video/3gpp; wmv video/x-ms-wmv;
m2ts video/mp2t; mxf video/mxf; av1 video/av1; mp3 audio/mpeg; ogg audio/ogg; flac audio/flac; wav audio/wav; m4a audio/mp4; aac audio/aac;
midi audio/midi; opus audio/ogg; oga audio/ogg; weba audio/webm; wma audio/x-ms-wma; aiff audio/aiff; pdf application/pdf;
docx application/vnd.openxmlformats-officedocument.wordprocessingml.document;
xlsx application/vnd.openxmlformats-officedocument.spreadsheetml.sheet;
pptx application/vnd.openxmlformats-officedocument.presentationml.presentation; odt application/vnd.oasis.opendocument.text;
odp application/vnd.oasis.opendocument.presentation; ods application/vnd.oasis.opendocument.spreadsheet; doc application/msword;
xls application/vnd.ms-excel; ppt application/vnd.ms-powerpoint; epub application/epub+zip; rtf application/rtf; html text/html;
xhtml application/xhtml+xml; zip application/zip; tar application/x-tar; gz application/gzip; rar application/vnd.rar;
7z application/x-7z-compressed; xml text/xml; json application/json; txt text/plain; csv text/csv; md text/markdown;
usdz model/vnd.usdz+zip; usd model/vnd.usdz+zip; glb model/gltf-binary; gltf model/gltf+json; obj model/obj; fbx application/vnd.fbx;
dae model/vnd.collada+xml; stl model/stl; vrml model/vrml; step model/step; iges model/iges
"""
#: Extension of a media type.
EXTENSION_OF = """
image/jpeg jpeg; image/png png; image/gif gif; image/webp webp; image/bmp bmp; image/tiff tiff; image/avif avif; image/heic heic;
image/heif heic; image/svg+xml svg; image/emf emf; image/x-xcf xcf; image/apng apng; image/vnd.microsoft.icon ico; image/jxl jxl;
image/vnd.adobe.photoshop psd; image/jp2 jp2; video/mp4 mp4; video/quicktime mov; video/webm webm; video/mpeg mpeg; video/ogg ogv;
video/x-flv flv; video/mp2t ts; video/3gpp 3gp; video/x-ms-wmv wmv; video/mxf mxf; video/av1 av1; audio/mpeg mp3; audio/ogg ogg;
audio/flac flac; audio/wav wav; audio/mp4 m4a; audio/aac aac; audio/midi midi; audio/x-midi midi; audio/webm weba; audio/x-ms-wma wma;
audio/aiff aiff; application/pdf pdf; application/zip zip; application/gzip gz;
application/vnd.openxmlformats-officedocument.wordprocessingml.document docx;
application/vnd.openxmlformats-officedocument.spreadsheetml.sheet xlsx;
application/vnd.openxmlformats-officedocument.presentationml.presentation pptx; application/vnd.oasis.opendocument.text odt;
application/vnd.oasis.opendocument.presentation odp; application/vnd.oasis.opendocument.spreadsheet ods; application/msword doc;
application/vnd.ms-excel xls; application/vnd.ms-powerpoint ppt; application/epub+zip epub; application/rtf rtf; model/vnd.usdz+zip usdz;
model/gltf-binary glb; model/gltf+json gltf; model/obj obj; application/vnd.fbx fbx; model/vnd.collada+xml dae; model/stl stl;
text/html html; text/xml xml; text/plain txt; text/csv csv; text/markdown md; application/json json
"""
#: Media types by kind, beyond those that begin with image/, video/, audio/ and text/.
MIME_DOCUMENT = (
    "text/html application/xhtml+xml application/pdf application/msword application/vnd.openxmlformats-officedocument.wordprocessingml.document "
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet application/vnd.openxmlformats-officedocument.presentationml.presentation "
    "application/vnd.oasis.opendocument.text application/vnd.oasis.opendocument.spreadsheet application/vnd.oasis.opendocument.presentation "
    "application/vnd.ms-excel application/vnd.ms-powerpoint application/epub+zip application/rtf"
)
MIME_ARCHIVE = "application/zip application/x-tar application/gzip application/x-bzip2 application/x-xz application/vnd.rar application/x-7z-compressed"
MIME_GEOMETRY = "model/vnd.usdz+zip model/gltf-binary model/gltf+json application/vnd.fbx model/vnd.collada+xml model/obj model/stl"
#: Extensions by what a tier can do with them.
TIER2_IMAGES = "jpeg jpg png webp bmp tiff tif gif ico psd avif heic heif dng cr2 nef arw orf rw2 pef srw raf 3fr fff iiq raw"
RAW_PREVIEWS = "dng cr2 nef arw orf rw2 pef srw raf 3fr fff iiq raw"
STUDIO_IMAGES = "exr sxr mxr hdr rgbe dpx cin dds fits iff pic rla zfile sgi rgb rgba bw int inta"
LINEAR_IMAGES = "exr hdr rgbe sxr mxr"
TONE_MAPPED = "stl obj"
#: The order in which cheap ways to a thumbnail are tried, and the extensions each is for.
SHORTCUTS = [
    ("exif", "image", "jpeg tiff png"), ("webp_exif", "image", "webp"), ("small", "image", "jpeg png gif bmp tiff ico"), ("progressive", "image", "jpeg"),
    ("raw", "image", "dng cr2 nef arw orf rw2 pef srw 3fr mef rwl"), ("zip", "document", "docx xlsx pptx odt ods odp"), ("pdf", "document", "pdf"), ("mp3", "audio", "mp3"),
]
#: Tier where no format of a kind is listed.
DEFAULT_TIER = {"archive": 1, "text": 1, "binary": 1, "unknown": 1, "image": 1, "vector": 2, "video": 2, "audio": 2, "document": 2, "geometry": 3}


def _pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in text.replace("\n", " ").split(";") if x.strip()]


def format_rows() -> list[tuple[str, int, str, bool, str]]:
    """(kind, tier, renderer, shortcut, extension)."""
    return [(kind, tier, renderer, shortcut, e) for kind, tier, renderer, shortcut, names in FORMATS for e in names.split()]


def alias_rows() -> list[tuple[str, str]]:
    return [(a, to) for to, names in ALIASES.items() for a in names.split()]


def kind_rows() -> list[tuple[str, str]]:
    return [(e, kind) for kind, names in KINDS.items() for e in names.split()]


def mime_rows() -> list[tuple[str, str]]:
    return _pairs(MIME_OF)


def extension_rows() -> list[tuple[str, str]]:
    return _pairs(EXTENSION_OF)
