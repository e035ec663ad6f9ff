"""quillgrid: questions over spreadsheet-shaped data, answered by Spark DataFrame plans."""
