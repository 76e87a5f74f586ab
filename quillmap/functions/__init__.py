"""Part of quillmap."""
