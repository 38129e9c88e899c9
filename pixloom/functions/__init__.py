"""Tables, distributions and keyed draws that operators share."""
