"""Tables: registered files, managed tables, temporary rows; printing of results."""
