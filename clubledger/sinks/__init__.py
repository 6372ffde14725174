"""Writers for lists, rosters, the newsletter and the receiver payload."""
