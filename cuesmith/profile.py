"""What is particular to a site: its hosts, labels, banners and limits."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1 << 20

#: The labels that end a labelled value on a result card.
CARD_LABELS = (
    "版本", "格式", "字幕格式", "语种", "语言", "字幕语种", "来源", "制作", "校订",
    "上传", "日期", "发布时间", "字幕文件名", "查阅次数", "下载次数", "翻译质量",
)


@dataclass(frozen=True)
class SiteProfile:
    """A site's constants. ``site`` is the bare host; its subdomains belong to it, ``file<digits>.site`` serve files."""

    site: str = "subs.example"
    labels: tuple[str, ...] = CARD_LABELS
    version_label: str = "版本"
    format_label: str = "格式"
    language_labels: tuple[str, ...] = ("语言", "语种", "字幕语种")
    date_labels: tuple[str, ...] = ("日期", "发布时间")
    wanted_format: str = "subrip(srt)"
    banners: tuple[str, ...] = ("top-banner", "bottom-banner")
    results_class: str = "resultcard"
    card_class: str = "subitem"
    version_box: str = "meta_top"
    version_title_class: str = "sublist_box_title_l"
    detail_mark: str = "/sub/"
    max_page_bytes: int = 4 * MIB
    max_archive_bytes: int = 16 * MIB
    max_srt_bytes: int = 32 * MIB
    max_entries: int = 1000
    max_redirects: int = 5
    max_search_page: int = 100
    max_query_units: int = 100
    max_kv_bytes: int = 4 * MIB
    ttl_ms: int = 24 * 60 * 60 * 1000

    @property
    def origin(self) -> str:
        return f"https://{self.site}"


DEFAULT = SiteProfile()
