"""Set-oriented operators over tables, cells, questions and answers."""
