"""Fixed tables of drawing records: names, codes and which fields a block may set."""

from __future__ import annotations

# Type names by category, in the order in which categories are tried.
CATEGORIES = {
    "Rendering-Critical": """line line_16r draw_line_16r circle circle_16r draw_circle_16r ellipse draw_ellipse draw_ellipse_32r
        polyline_polygon polyline_polygon_16r draw_polyline_polygon_16r
        polytriangle polytriangle_16r polytriangle_32r draw_polytriangle_16r draw_polytriangle_32r
        quad quad_32r quad_ascii wedge bezier bezier_16r bezier_32r bezier_32 contour draw_contour_set_16r draw_contour_set_32r
        gouraud_polytriangle gouraud_polyline draw_gouraud_polytriangle_16r draw_gouraud_polytriangle_32r
        draw_gouraud_polyline_16r draw_gouraud_polyline_32r draw_circular_arc_32r
        ascii_line ascii_circle ascii_ellipse ascii_polyline_polygon ascii_polytriangle""",
    "Attribute": """SET_COLOR_RGBA set_color_rgba set_color_rgb32 color_rgb32 SET_COLOR_INDEXED set_color_indexed set_color_map_index
        color_map_index set_background_color background_color color SET_FILL_ON set_fill_on SET_FILL_OFF set_fill_off
        set_pen_width set_line_width line_weight set_line_cap set_line_join line_pattern
        SET_VISIBILITY_ON set_visibility_on visibility_off set_marker_symbol set_marker_size draw_marker
        anti_alias halftone highlight set_clip_region clear_clip_region set_mask
        set_origin origin_16r set_origin_32 set_units units_ascii units_binary set_macro_index macro_scale_ascii macro_scale_binary set_layer""",
    "Text": "draw_text_basic draw_text_complex set_font set_text_rotation set_text_scale set_text_spacing",
    "Image": """image_rgb image_rgba image_png image_jpeg image_indexed image_mapped draw_image draw_image_rgb draw_image_rgba
        draw_image_png draw_image_jpeg draw_image_indexed draw_image_mapped bitonal_mapped group3x_mapped group4 group4x_mapped draw_png_group4_image""",
    "State": "save_state restore_state reset_state",
    "Metadata": """metadata copyright creator creation_time modification_time source_creation_time source_modification_time
        dwf_header end_of_dwf viewport view named_view user_block null_block global_sheet_block global_block signature_block
        font_extension colormap compression_marker overlay_preview font_block encryption password signdata nop stream_version end_of_stream
        author comments title subject keywords source_filename plot_info define_units set_inked_area filetime
        guid guid_list blockref directory userdata object_node graphics_hdr overlay_hdr redline_hdr embed url attribute_url""",
    "Structure": "object_node_auto object_node_32 object_node_16 draw_macro_ascii draw_macro_32r draw_macro_16r extended_ascii extended_binary single_byte",
    "Unknown": "unknown unknown_binary unknown_extended_ascii unknown_extended_binary",
    "Error": "error",
}
DEFAULT_CATEGORY = "Uncategorized"

# Types that the renderer draws, applies or passes over.
IMPLEMENTED = """line line_16r circle circle_16r ellipse draw_ellipse polyline_polygon polyline_polygon_16r
    polytriangle polytriangle_16r polytriangle_32r quad quad_32r wedge bezier contour gouraud_polytriangle gouraud_polyline
    draw_text_basic draw_text_complex image_rgb image_rgba image_png image_jpeg image_indexed image_mapped draw_marker
    save_state restore_state reset_state SET_COLOR_RGBA set_color_rgba set_color_rgb32 SET_COLOR_INDEXED set_color_indexed
    set_background_color set_color_map_index SET_FILL_ON set_fill_on SET_FILL_OFF set_fill_off
    set_pen_width set_line_width set_line_cap set_line_join set_font set_text_rotation set_text_scale set_text_spacing set_origin set_units
    SET_VISIBILITY_ON set_visibility_on set_marker_symbol set_marker_size set_anti_alias set_halftone set_highlight
    set_clip_region clear_clip_region set_mask metadata copyright creator creation_time modification_time source_creation_time
    source_modification_time dwf_header end_of_dwf viewport view named_view user_block null_block global_sheet_block global_block
    signature_block font_extension colormap compression_marker overlay_preview font_block encryption password signdata nop
    stream_version end_of_stream extended_ascii extended_binary single_byte""".split()

# Codes of units, line patterns and markers, from 0.
UNITS = "none in ft mm cm m".split()
LINE_PATTERNS = """INVALID SOLID DASHED DOTTED DASH_DOT SHORT_DASH MEDIUM_DASH LONG_DASH SHORT_DASH_X2 MEDIUM_DASH_X2 LONG_DASH_X2
    MEDIUM_LONG_DASH MEDIUM_DASH_SHORT_DASH_SHORT_DASH LONG_DASH_SHORT_DASH LONG_DASH_DOT_DOT LONG_DASH_DOT MEDIUM_DASH_DOT_SHORT_DASH_DOT
    SPARSE_DOT ISO_DASH ISO_DASH_SPACE ISO_LONG_DASH_DOT ISO_LONG_DASH_DOUBLE_DOT ISO_LONG_DASH_TRIPLE_DOT ISO_DOT
    ISO_LONG_DASH_SHORT_DASH ISO_LONG_DASH_DOUBLE_SHORT_DASH ISO_DASH_DOT ISO_DOUBLE_DASH_DOT ISO_DASH_DOUBLE_DOT
    ISO_DOUBLE_DASH_DOUBLE_DOT ISO_DASH_TRIPLE_DOT ISO_DOUBLE_DASH_TRIPLE_DOT DECORATED_TRACKS DECORATED_WIDE_TRACKS
    DECORATED_CIRCLE_FENCE DECORATED_SQUARE_FENCE""".split()
MARKERS = "dot cross plus circle square triangle star".split()

# Content-stream operators by name (their letters differ in case only), and those that are counted together.
TOKENS = {
    "moveto": "m", "lineto": "l", "curve": "c", "rectangle": "re", "stroke": "S", "close_stroke": "s", "fill": "f", "fill_alt": "F", "fill_stroke": "B",
    "line_width": "w", "stroke_rgb": "RG", "fill_rgb": "rg", "save": "q", "restore": "Q", "transform": "cm", "show_text": "Tj", "show_text_array": "TJ", "text_position": "Td",
}
TOKEN_TOTALS = {
    "total_path_ops": ["moveto", "lineto", "curve", "rectangle"], "total_paint_ops": ["stroke", "close_stroke", "fill", "fill_alt", "fill_stroke"],
    "total_color_ops": ["stroke_rgb", "fill_rgb"], "total_text_ops": ["show_text", "show_text_array", "text_position"],
}

# Block formats, and the fields that each group of them may set.
FORMATS = "Graphics_HDR Overlay_HDR Redline_HDR Thumbnail Preview Overlay_Preview Font Graphics Overlay Redline User Null Global_Sheet Global Signature".split()
_HEADERS, _IMAGES = FORMATS[:3], FORMATS[3:6]
_FIELDS = [
    ("File_Offset Block_Size Validity", FORMATS),
    ("Block_Guid Creation_Time Modification_Time", [f for f in FORMATS if f != "Null"]),
    ("Encryption ZValue", _HEADERS + _IMAGES),
    ("Visibility", [*_HEADERS, "Null"]),
    ("Block_Meaning", ["Overlay_HDR"]),
    ("Parent_Block_Guid", [*_HEADERS[1:], *_IMAGES, "User", "Signature"]),
    ("Related_Overlay_Hdr_Block_Guid", ["Overlay_Preview"]),
    ("Sheet_Print_Sequence Print_Sequence_Modified_Time", ["Global_Sheet"]),
    ("""Plans_And_Specs_Website_Guid Last_Sync_Time Flag_Mini_Dwf Modified_Block_Timestamp Dwf_Container_Guid Container_Modified_Time
        Dwf_Discipline_Guid Dwf_Discipline_Modified_Time""", ["Global"]),
    ("""Scan_Flag Mirror_Flag Inversion_Flag Paper_Scale Orientation Rotation Alignment Inked_Area Dpi_Resolution Paper_Offset
        Clipping_Rectangle""", _HEADERS),
    ("Password", _HEADERS[1:]),
    ("Image_Representation Targeted_Matrix_Rep", _IMAGES),
]

#: (format, field) pairs that may be set.
ALLOWED = [(format_, field) for fields, formats in _FIELDS for field in fields.split() for format_ in formats]
FIELDS = [field for fields, _ in _FIELDS for field in fields.split()]
#: (type, category, priority)
RULES = [(name, category, k) for k, (category, names) in enumerate(CATEGORIES.items()) for name in names.split()]
#: (kind, code, name)
CODES = [(kind, k, name) for kind, names in (("unit", UNITS), ("line_pattern", LINE_PATTERNS), ("marker", MARKERS)) for k, name in enumerate(names)]
