"""Fixed values of the file tools: word lists, caps and formats that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Names of junk, compared in lower case.
JUNK_NAMES = ("thumbs.db", ".ds_store", "desktop.ini", "ehthumbs.db", ".apdisk", "npm-debug.log")
JUNK_SUFFIXES = (".tmp", ".temp", ".crdownload", ".part", ".partial")
JUNK_PREFIXES = ("~$", ".~lock.", "._")

# File categories by upper-case extension.
CATEGORIES = {
    "docs": "DOC DOCX XLS XLSX PPT PPTX PDF TXT RTF ODT ODS ODP CSV MD PAGES NUMBERS KEY",
    "video": "MP4 MOV M4V AVI MKV WMV FLV WEBM MPG MPEG M2TS MTS 3GP",
    "pic": "JPG JPEG PNG GIF BMP TIFF TIF HEIC HEIF WEBP SVG PSD AI RAW ARW CR2 CR3 NEF ORF RW2 DNG",
    "audio": "MP3 AAC M4A FLAC WAV OGG OGA OPUS WMA AIFF AIF DSF",
    "web": "HTML HTM CSS JS JSON XML PHP ASP ASPX JSP",
    "exe": "EXE MSI COM BAT SH BIN RUN APK DEB RPM PKG",
    "disk": "ISO IMG DMG VHD VHDX VMDK QCOW2",
    "zip": "ZIP RAR 7Z GZ BZ2 XZ TAR TGZ TBZ Z LZ4 ZST",
}

# Words a verdict is found by, and what it is called.
VERDICT_WORDS = {"corrupt": "corrupt corrupted damaged", "intact": "intact good ok", "unknown": "unknown undetermined unclear"}
VERDICT_LABELS = {"corrupt": "Corrupted", "intact": "Intact", "unknown": "Undetermined"}

# Tools in the order in which they run, the folder each moves to, and CSV headers.
TOOLS = ("empty_folders", "empty_files", "temp_files", "duplicates", "corrupted_files")
READ_ONLY_TOOLS = ("corrupted_files",)
TOOL_FOLDERS = {"duplicates": "Duplicates", "empty_folders": "Empty Folders", "empty_files": "Empty Files", "temp_files": "Temporary Files"}
CSV_DUPLICATES = ("Group", "Hash", "Name", "Location", "Size (bytes)", "Modified", "Created", "Captured", "Hard Links")
CSV_CONFLICTS = ("Set", "Name", "Location", "Size (bytes)", "Modified", "Content Hash", "Status", "Evidence")
CSV_FLAT = ("Name", "Location", "Size (bytes)", "Modified", "Created", "Type")

MIB = 1 << 20
PREFIX_BYTES = 65_536


@dataclass(frozen=True)
class Limits:
    """Caps of results; tests and queries over small tables shrink them."""

    duplicate_rows: int = 100_000
    group_rows: int = 100_000
    flat_rows: int = 20_000
    empty_folder_rows: int = 20_000
    conflict_rows: int = 20_000
    skewed_family: int = 25_000
    skew_sample: int = 500
    skew_each: int = 2
    history_rows: int = 500_000
    page_groups: int = 100
    page_groups_most: int = 5_000
    page_rows: int = 500
    page_rows_most: int = 20_000
    trim_page: int = 2_000
    trim_group: int = 500
    trim_least: int = 2
    error_rows: int = 20_000


LIMITS = Limits()
