"""Part of spandrel."""
